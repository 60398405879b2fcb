"""Numbers to digit text and back, as column expressions.

``prec`` may be an int or a column: a parameter grid varies it row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.functions.columns import bound_once, column
from numerale.settings import DIGIT_TOLERANCE, TextFormat

_EXACT_LONG = 1e18

#: Columns that refer to earlier ones of the same select cost one analyzer pass each, and passes are limited.
_POSITIONS_PER_SELECT = 10


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _prec(fmt: TextFormat, prec: Column | int | None) -> Column:
    return F.lit(fmt.prec) if prec is None else column(prec)


def _unit(fmt: TextFormat, prec: Column | int | None) -> Column:
    """base ** prec, folded to a literal when prec is not a column."""
    if prec is None or isinstance(prec, int):
        return F.lit(float(fmt.base ** (fmt.prec if prec is None else prec)))
    return F.pow(F.lit(float(fmt.base)), column(prec))


def is_missing(z: Column) -> Column:
    """No number to write: NULL, NaN, or infinite."""
    return z.isNull() | F.isnan(z) | (F.abs(z) == float("inf"))


def _size(z: Column | str) -> Column:
    """|z|, NULL where it is missing."""
    z = column(z)
    return F.when(~is_missing(z), F.abs(z))


def _whole(x: Column) -> Column:
    """A whole non-negative double as text, of any size."""
    return F.when(x >= _EXACT_LONG, F.format_string("%.0f", x)).otherwise(F.floor(x).cast("string"))


def overflows(z: Column | str, fmt: TextFormat) -> Column:
    """True where the value has more integer digits than the format provides."""
    return _size(z) >= F.lit(float(fmt.max_val))


def decimal_digits(z: Column | str, fmt: TextFormat, prec: Column | int | None = None) -> Column:
    """The cut decimal digits of ``|z|`` as one string without leading zeros."""
    units = _size(z) * _unit(fmt, prec) + F.lit(DIGIT_TOLERANCE)
    # beyond 2^53 a double has no fraction left, so the wide branch needs no cut; units that overflow to
    # infinity have their places put after the digits instead
    places = F.repeat(F.lit("0"), _prec(fmt, prec))
    wide = F.when(units == float("inf"), F.concat(_whole(_size(z)), places)).otherwise(_whole(units))
    return wide


def with_greedy_digits(df: DataFrame, col: str, fmt: TextFormat, prec: Column | int | None = None) -> DataFrame:
    """Divide, truncate and subtract per position in float64: adds the digits as text, ``_spaced``.

    Selects whose columns build on each other, which Spark turns into a
    chain of projections compiled together.  The first digit may exceed 9.
    With ``prec`` as a column the format's ``max_prec`` says how many places
    are prepared; a row that asks for more is an error, never cut short.
    """
    base = float(fmt.base)
    places = fmt.prec if prec is None else prec if isinstance(prec, int) else fmt.max_prec
    powers = [base**k for k in range(fmt.int_digits - 1, -1, -1)] + [base**-k for k in range(1, places + 1)]
    rows, pieces = df.withColumn("_r0", _size(col)), []
    for begin in range(0, len(powers), _POSITIONS_PER_SELECT):
        columns = []
        for k, power in list(enumerate(powers))[begin : begin + _POSITIONS_PER_SELECT]:
            digit, rest = F.col(f"_d{k}"), F.col(f"_r{k}")
            # whole part by subtraction: the first digit takes whatever exceeds the positions, however much
            ratio = rest / power
            columns += [(ratio - ratio % 1.0).alias(f"_d{k}"), (rest - digit * power).alias(f"_r{k + 1}")]
            piece = F.concat(F.lit(fmt.bit_sep), _whole(digit) if k == 0 else digit.cast("bigint").cast("string"))
            if isinstance(prec, Column) and k >= fmt.int_digits:
                piece = F.when(prec > k - fmt.int_digits, piece).otherwise(F.lit(""))
            pieces.append(piece)
        rows = rows.select("*", *columns)
    zeros = f"^(?:{_quoted(fmt.bit_sep + '0')})+(?={_quoted(fmt.bit_sep) if fmt.bit_sep else '.'})"
    spaced = F.regexp_replace(F.concat(*pieces), zeros, "")
    if isinstance(prec, Column):
        beyond = F.raise_error(F.lit(f"prec exceeds max_prec={places} of the text format")).cast("string")
        spaced = F.when(prec > places, beyond).otherwise(spaced)
    return rows.select(*df.columns, spaced.alias("_spaced"))


def greedy_digits(z: Column | str, fmt: TextFormat, prec: Column | int | None = None) -> Column:
    """The digits of ``with_greedy_digits`` as one expression, for values inside arrays."""
    base = float(fmt.base)
    places = fmt.prec if prec is None else prec if isinstance(prec, int) else fmt.max_prec
    powers = [base**k for k in range(fmt.int_digits - 1, -1, -1)] + [base**-k for k in range(1, places + 1)]
    positions = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(power).alias("power")) for k, power in enumerate(powers)])

    def position(state: Column, p: Column) -> Column:
        def cut(digit: Column) -> Column:
            piece = F.concat(F.lit(fmt.bit_sep), F.when(p["k"] == 0, _whole(digit)).otherwise(digit.cast("bigint").cast("string")))
            if isinstance(prec, Column):
                piece = F.when((p["k"] < fmt.int_digits) | (prec > p["k"] - fmt.int_digits), piece).otherwise(F.lit(""))
            return F.struct((state["rest"] - digit * p["power"]).alias("rest"), F.concat(state["text"], piece).alias("text"))

        return bound_once(state["rest"] / p["power"], lambda ratio: bound_once(ratio - ratio % 1.0, cut))

    begin = F.struct(_size(z).alias("rest"), F.lit("").alias("text"))
    zeros = f"^(?:{_quoted(fmt.bit_sep + '0')})+(?={_quoted(fmt.bit_sep) if fmt.bit_sep else '.'})"
    spaced = F.regexp_replace(F.aggregate(positions, begin, position)["text"], zeros, "")
    if isinstance(prec, Column):
        beyond = F.raise_error(F.lit(f"prec exceeds max_prec={places} of the text format")).cast("string")
        spaced = F.when(prec > places, beyond).otherwise(spaced)
    return spaced


def spaced_digits(z: Column | str, fmt: TextFormat, prec: Column | int | None = None) -> Column:
    """Decimal digits of ``|z|``, each led by ``bit_sep``."""
    return F.concat(F.lit(fmt.bit_sep), F.array_join(F.split(decimal_digits(z, fmt, prec), ""), fmt.bit_sep))


def signed_chunk(z: Column | str, spaced: Column, fmt: TextFormat) -> Column:
    """One time step as text: the sign before its digits; a missing value is the marker alone."""
    z = column(z)
    sign = F.when(z < 0, F.lit(fmt.minus_sign)).otherwise(F.lit(fmt.plus_sign))
    return F.when(is_missing(z), F.lit(fmt.missing_str)).otherwise(F.concat(sign, spaced))


def ensure_terminated(text: Column | str, fmt: TextFormat) -> Column:
    text = column(text)
    return F.when(text.endswith(fmt.time_sep), text).otherwise(F.concat(text, F.lit(fmt.time_sep)))


def token_array(chunk: Column | str, fmt: TextFormat) -> Column:
    """Tokens of one chunk and its separator: sign, one per digit, time_sep."""
    chunk = column(chunk)
    negative, body = _signed_body(chunk, fmt)
    pieces = F.split(body, f"(?={_quoted(fmt.bit_sep)})" if fmt.bit_sep else "")
    plus = F.array(F.lit(fmt.plus_sign)) if fmt.plus_sign else F.array().cast("array<string>")
    sign = F.when(negative, F.array(F.lit(fmt.minus_sign))).otherwise(plus)
    end = F.array(F.lit(fmt.time_sep))
    return F.when(chunk == fmt.missing_str, F.array(F.lit(fmt.missing_str), F.lit(fmt.time_sep))).otherwise(
        F.concat(sign, pieces, end)
    )


def _signed_body(chunk: Column, fmt: TextFormat) -> tuple[Column, Column]:
    """Whether a chunk is negative, and what follows its sign."""
    negative = chunk.startswith(fmt.minus_sign)
    after = F.when(negative, len(fmt.minus_sign) + 1).otherwise(len(fmt.plus_sign) + 1)
    return negative, F.substring(chunk, after, F.length(chunk))


def token_codes(chunk: Column | str, fmt: TextFormat) -> Column:
    """Tokens of one chunk and its separator as a text of one character each (``fmt.codes``).

    Tokens outside the vocabulary (digits beyond the base) become '?'.
    """
    chunk, codes = column(chunk), fmt.codes
    if fmt.base <= 10 and fmt.digit_mode == "decimal":
        negative, body = _signed_body(chunk, fmt)
        sign = F.when(negative, codes[fmt.minus_sign]).otherwise(codes.get(fmt.plus_sign, ""))
        digits = F.replace(body, F.lit(fmt.bit_sep), F.lit("")) if fmt.bit_sep else body
        text = F.when(chunk == fmt.missing_str, F.lit(codes[fmt.missing_str])).otherwise(F.concat(sign, digits))
        return F.concat(text, F.lit(codes[fmt.time_sep]))
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.array_join(
        F.transform(token_array(chunk, fmt), lambda t: F.coalesce(F.try_element_at(known, t), F.lit("?"))), ""
    )


def token_of_code(code: Column, fmt: TextFormat) -> Column:
    """The token behind one character; NULL stays NULL."""
    known = F.create_map(*[F.lit(x) for tok, c in fmt.codes.items() for x in (c, tok)])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(known, code), F.lit("?")))


def token_count(text: Column | str, fmt: TextFormat) -> Column:
    """Tokens of a text whose pieces each begin with one space.

    Holds for formats where digits, signs and separators are space-led;
    any other format must bring its own count column.
    """
    led = [fmt.bit_sep, fmt.time_sep, fmt.minus_sign, fmt.missing_str] + ([fmt.plus_sign] if fmt.plus_sign else [])
    if any(not re.fullmatch(r" [^ ]*", t) for t in led) or fmt.bit_sep != " ":
        raise ValueError("tokens can be counted from spaces only when every piece is led by one space")
    text = column(text)
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    if fmt.missing_tokens == 1:
        return spaces
    gone = F.length(F.replace(text, F.lit(fmt.missing_str), F.lit("")))
    return spaces + ((F.length(text) - gone) / len(fmt.missing_str)).cast("int") * (fmt.missing_tokens - 1)


def split_chunks(text: Column | str, fmt: TextFormat) -> Column:
    """Chunks of a completion: split, drop empty ones, then always drop the last."""
    filled = F.filter(F.split(column(text), _quoted(fmt.time_sep), -1), lambda p: F.length(p) > 0)
    return bound_once(filled, lambda f: F.slice(f, F.lit(1), F.greatest(F.size(f) - 1, F.lit(0))))


def decode_chunk(chunk: Column | str, fmt: TextFormat, prec: Column | int | None = None) -> Column:
    """One chunk back to a number, half a bin added; NULL when it is malformed.

    Malformed is whatever has a piece that is not an integer.  A piece may
    hold several digits or its own minus, so the general way weighs each
    piece by its place; plain single digits are read as one number.
    """
    negative, body = _signed_body(column(chunk), fmt)
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    gap = _quoted(fmt.bit_sep)
    if fmt.bit_sep.strip():
        # the separator before the first digit, where it is not white space
        body = F.regexp_replace(body, f"^{gap}", "")
    bits = F.split(body, gap, -1) if fmt.bit_sep else F.split(body, "")
    # try_cast: the branches are only reached for digits, but ANSI casts may be evaluated early
    weighed = F.aggregate(bits, F.lit(0.0), lambda a, b: a * float(fmt.base) + b.try_cast("double"))
    piece = "-?[0-9]+"
    valid = body.rlike(f"^{piece}(?:{gap}{piece})*\\z" if fmt.bit_sep else r"^[0-9]+\z")
    whole = F.when(valid, weighed)
    if fmt.base == 10:
        joined = F.replace(body, F.lit(fmt.bit_sep), F.lit("")) if fmt.bit_sep else body
        plain = body.rlike(f"^[0-9](?:{gap}[0-9])*\\z" if fmt.bit_sep else r"^[0-9]+\z")
        whole = F.when(plain, joined.try_cast("double")).otherwise(whole)
    unit = _unit(fmt, prec)
    size = whole / unit + (F.lit(0.5) / unit if fmt.half_bin else F.lit(0.0))
    return F.when(negative, -size).otherwise(size)
