"""How a number is written as text, and the model limits that go with it."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Limits and defaults the forecasting method is defined with.
CONTEXT_TOKENS = 4097
STEP_MULTIPLIER = 1.2
HEADROOM = 1.05
TOKEN_BIAS = 30
REQUEST_SEED = 1234
SCALE_FLOOR = 0.01

#: Decimal digits are cut, not rounded.  A scaled value is first raised by this
#: share of one digit so that 1.23 * 1000 = 1229.9999999999998 is cut to 1230
#: and a difference in the last bit between two machines never moves a digit.
DIGIT_TOLERANCE = 5e-7

@dataclass(frozen=True)
class TextFormat:
    """Settings of the number <-> text mapping.

    ``digit_mode='decimal'`` writes the exact decimal digits (base 10 only);
    ``'greedy'`` divides, truncates and subtracts in float64, position by
    position, and so shows the drift of that procedure (1.23 -> 1 2 2 9).
    """

    # The defaults of the text format.
    prec: int = 3
    base: int = 10
    max_val: float = 1e7
    time_sep: str = " ,"
    bit_sep: str = " "
    plus_sign: str = ""
    minus_sign: str = " -"
    missing_str: str = " Nan"
    half_bin: bool = True

    digit_mode: str = "decimal"
    missing_tokens: int = 1
    #: Places prepared in greedy mode where ``prec`` comes from a column; a grid's plans take the grid's largest.
    max_prec: int = 15

    def __post_init__(self) -> None:
        if self.digit_mode not in ("decimal", "greedy"):
            raise ValueError(f"unknown digit_mode: {self.digit_mode!r}")
        if self.digit_mode == "decimal" and self.base != 10:
            raise ValueError("digit_mode='decimal' needs base 10; use 'greedy'")
        if self.base < 2 or self.prec < 0:
            raise ValueError("need base >= 2 and prec >= 0")
        if not self.time_sep or not self.minus_sign:
            raise ValueError("time_sep and minus_sign must not be empty")

    @property
    def int_digits(self) -> int:
        """Digit positions before the decimal point."""
        return math.ceil(math.log(self.max_val) / math.log(self.base))

    @property
    def digit_tokens(self) -> list[str]:
        return [f"{self.bit_sep}{d}" for d in range(self.base)]

    def allowed_tokens(self, scoring: bool = False) -> list[str]:
        """Tokens a completion may hold; scoring also accepts a bare bit_sep."""
        marks = [self.time_sep, self.plus_sign, self.minus_sign]
        if scoring:
            marks.append(self.bit_sep)
        return list(dict.fromkeys(t for t in self.digit_tokens + marks if t))

    @property
    def vocabulary(self) -> list[str]:
        """Every token the serialiser can write: the allowed ones and the missing marker."""
        return list(dict.fromkeys([*self.allowed_tokens(), self.missing_str]))

    @property
    def codes(self) -> dict[str, str]:
        """One character per vocabulary token, so that a text can be cut by position."""
        marks = {self.time_sep: ",", self.minus_sign: "-", self.plus_sign: "+", self.missing_str: "N"}
        named = {t: str(d) if d < 10 else chr(0x100 + d) for d, t in enumerate(self.digit_tokens)}
        return {t: named.get(t) or marks[t] for t in self.vocabulary}
