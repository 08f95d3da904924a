"""Text to value expressions used by the feed loaders. None of them raises on bad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from navscore.schemas import VALUE

# How each separator is written in a pattern.
SEPARATOR_PATTERNS = {"\t": "\t", "|": r"\|"}


def split_fields(line: Column, separator: str) -> Column:
    """Split a line; empty fields at its end do not count towards the number of fields."""
    return F.split(F.rtrim(line, F.lit(separator)), SEPARATOR_PATTERNS[separator])


def number(text: Column) -> Column:
    """The number in a text, or null; :func:`unusable` finds those that are not finite."""
    return text.try_cast(VALUE)


def unusable(name: str, is_number: bool) -> Column:
    """True for a parsed column that is null, or a number that is not finite."""
    value = F.col(name)
    return ~(F.abs(value) < F.lit(float("inf"))) | value.isNull() if is_number else value.isNull()


def day_compact(text: Column) -> Column:
    """``yyyyMMdd`` in the first eight characters; anything behind them is ignored."""
    return F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")


def day_slashed(text: Column) -> Column:
    """``yyyy/MM/dd``, single-digit months and days included."""
    return F.try_to_date(F.regexp_extract(text, r"^\s*(\d{4}/\d{1,2}/\d{1,2})", 1), "yyyy/M/d")


def day_of_timestamp(text: Column) -> Column:
    """The day of ``yyyy/MM/dd HH:mm``; null when the time of day is missing."""
    day = F.regexp_extract(text, r"^\s*(\d{4}/\d{1,2}/\d{1,2}) +\d{1,2}:\d{1,2}", 1)
    return F.try_to_date(day, "yyyy/M/d")


def day_dashed(text: Column) -> Column:
    """``yyyy-MM-dd``."""
    return F.try_to_date(F.regexp_extract(text, r"^\s*(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")


def percent_number(text: Column) -> Column:
    """``"+1.23%"`` to 1.23: quotes, plus and percent signs are stripped."""
    return number(F.translate(text, '%"+', ""))


def percent_text(value: Column) -> Column:
    """1.230 to ``1.230%``."""
    return F.concat(value.cast("string"), F.lit("%"))
