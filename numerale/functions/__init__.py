"""Column expressions: dates, digits, chunks, tokens.  All run inside the JVM."""

from numerale.functions.columns import bound_once, by_key, key_columns, newest_first, require_columns
from numerale.functions.dates import week_end
from numerale.functions.digits import (
    decimal_digits,
    decode_chunk,
    ensure_terminated,
    greedy_digits,
    overflows,
    signed_chunk,
    spaced_digits,
    split_chunks,
    token_array,
    token_codes,
    token_count,
    token_of_code,
    with_greedy_digits,
)

__all__ = [
    "bound_once", "by_key", "key_columns", "newest_first", "require_columns", "week_end", "decimal_digits", "decode_chunk", "ensure_terminated",
    "greedy_digits", "overflows", "signed_chunk", "spaced_digits", "split_chunks", "token_array", "token_codes", "token_count",
    "token_of_code", "with_greedy_digits",
]
