"""Lenient text parsing: numbers that fall back to zero, timestamps that fall back to null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..params import WALL_CLOCK_OFFSET

# Code points of the characters stripped from both ends of a cell (Unicode white space).
WHITE_SPACE_CODES = (
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288,
)
WHITE_SPACE = "".join(map(chr, WHITE_SPACE_CODES))

# The spellings of a number. Single underscores may group digits;
# type suffixes such as "1.0d" are not numbers.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
NAN_WORDS = ("nan", "+nan", "-nan")
POSITIVE_INF_WORDS = ("inf", "+inf", "infinity", "+infinity")
NEGATIVE_INF_WORDS = ("-inf", "-infinity")

# Year-month-day, then "T" or white space, then hour:minute:second, parts may be
# unpadded and a one-digit day may follow one extra blank.
WALL_CLOCK = (
    r"^((?!0000)\d{4})-(1[0-2]|0?[1-9])-(?: (?=[1-9](?:[Tt]|\s)))?(3[01]|[12]\d|0?[1-9])"
    r"(?:[Tt]|\s+)(2[0-3]|[01]?\d):([0-5]?\d):([0-5]?\d)$"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def number_or_null(text: Column) -> Column:
    """Double, or null when the text is missing or is not a number."""
    s = strip(text)
    word = F.lower(s)
    return (
        F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
        .when(word.isin(*NAN_WORDS), F.lit(float("nan")))
        .when(word.isin(*POSITIVE_INF_WORDS), F.lit(float("inf")))
        .when(word.isin(*NEGATIVE_INF_WORDS), F.lit(float("-inf")))
    )


def float_or_zero(text: Column) -> Column:
    return F.coalesce(number_or_null(text), F.lit(0.0))


def int_or_zero(text: Column) -> Column:
    """Truncates toward zero; not-a-number, infinite and out-of-range values become 0."""
    return F.coalesce(number_or_null(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_non_empty(*texts: Column) -> Column:
    """White space counts as non-empty, so it wins over a later good value."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts]) if texts else F.lit(None).cast("string")


def wall_clock_to_instant(text: Column, offset: str = WALL_CLOCK_OFFSET) -> Column:
    """Timestamp of a wall-clock text at ``offset``, or null. Needs a UTC session."""
    s = strip(text)
    plain = F.regexp_replace(s, WALL_CLOCK, "$1-$2-$3 $4:$5:$6")
    parsed = F.try_to_timestamp(plain, F.lit("yyyy-M-d H:m:s"))
    return F.when(s.rlike(WALL_CLOCK), F.to_utc_timestamp(parsed, offset))
