"""Dates from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import trimmed


def to_ymd(c: Column) -> Column:
    """A date from `year-month-day` or `year/month/day` with a four-digit year; null for anything else. Each value is judged alone."""
    return parsed_ymd(trimmed(c))


def parsed_ymd(text: Column) -> Column:
    """The same of text that is trimmed already. The cast reads all that the pattern lets through, faster than a formatter."""
    return F.when(text.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}\z"), F.translate(text, "/", "-").try_cast("date"))
