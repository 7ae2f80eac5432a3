"""Scalar expressions shared by the ticket models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.schemas import ESCALATED, HIGH_URGENCY, NEGATIVE_SENTIMENTS


def row_total() -> Column:
    return F.count(F.lit(1))


# -- flags: never null, an unknown input gives false ---------------------------------


def negative_sentiment(sentiment: Column) -> Column:
    return F.coalesce(sentiment.isin(NEGATIVE_SENTIMENTS), F.lit(False))


def high_urgency(urgency: Column) -> Column:
    return F.coalesce(urgency == HIGH_URGENCY, F.lit(False))


def churn_risk(is_churned: Column, sentiment: Column) -> Column:
    return F.coalesce(is_churned, F.lit(False)) & negative_sentiment(sentiment)


def escalated(status: Column) -> Column:
    return F.coalesce(status == ESCALATED, F.lit(False))


# -- numbers -------------------------------------------------------------------------


def percent(part: Column, whole: Column) -> Column:
    """One decimal, half away from zero; ``whole`` must not be 0."""
    return F.round(F.lit(100.0) * part / whole, 1)


def percent_half_even(part: Column, whole: Column) -> Column:
    """One decimal, half to even; 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, 1)).otherwise(F.lit(0.0))


def batches_needed(rows: Column, size: int) -> Column:
    return F.ceil(rows / F.lit(size))


# -- casts ---------------------------------------------------------------------------


def _cast(column: Column, to: str, lenient: bool) -> Column:
    return column.try_cast(to) if lenient else column.cast(to)


def to_boolean(column: Column, lenient: bool = False) -> Column:
    return _cast(column, "boolean", lenient)


def to_whole_number(column: Column, lenient: bool = False) -> Column:
    """Integer from text or number, rounding half to even (``'3.0'`` -> 3, 3.5 -> 4)."""
    return _cast(F.bround(_cast(column, "double", lenient)), "int", lenient)


def to_day(column: Column, lenient: bool = False) -> Column:
    return _cast(column, "date", lenient)


# -- dates and text ------------------------------------------------------------------


def month_start(day: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(day, "MM")


def days_before(day: Column, days: Column) -> Column:
    """``yyyy-MM-dd`` text of ``day`` minus ``days``."""
    return F.date_format(F.date_sub(day, days.cast("int")), "yyyy-MM-dd")


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def numbered_id(prefix: str, number: Column, width: int) -> Column:
    """Prefix plus zero-padded number; a number longer than ``width`` is kept whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def hashed_id(prefix: str, *key: Column, digits: int = 16) -> Column:
    """Repeatable upper-case hex id of a key; eight digits would collide at scale."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(F.concat_ws("|", *key)), 1, digits)))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)
