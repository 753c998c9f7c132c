"""Numbers from text, and rounding to cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import trimmed

#: What counts as a number: the cast alone would also take a type suffix (`1d`) and NaN.
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def to_number(c: Column) -> Column:
    """A double, or null where the trimmed text is no number."""
    return parsed_number(trimmed(c))


def parsed_number(text: Column) -> Column:
    """The same of text that is trimmed already."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def is_whole(number: Column) -> Column:
    """Whether a double is an integer; null and infinite ones are not."""
    return F.coalesce(number % 1 == 0, F.lit(False))


def to_whole(text: Column) -> Column:
    """A 64-bit integer from trimmed text (`12`, `12.0`, `1e3`), or null where it is none or too large. Digits are read as they
    are: a double would merge numbers above 2**53."""
    exact = F.when(is_whole(parsed_number(text)), text.try_cast("decimal(38,0)").try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), exact)


def to_price(c: Column) -> Column:
    """A price from text with currency signs: only digits, comma, point and minus count, a comma is a point."""
    digits = F.regexp_replace(trimmed(c), r"[^0-9,.\-]", "")
    return to_number(F.replace(digits, F.lit(","), F.lit(".")))


def to_cents(c: Column) -> Column:
    """A double rounded to two places half away from zero in binary arithmetic (round(x, 2) rounds the decimal text instead)."""
    return F.round(c * F.lit(100.0)) / F.lit(100.0)


def money(c: Column) -> Column:
    return to_cents(c).cast("decimal(18,2)")
