"""Tolerant number parsing and binary-double rounding, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT = ("", "none", "missing", "n/a", "no")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def first_number(c: Column) -> Column:
    """First decimal number in a text as a double, else null."""
    return F.nullif(F.regexp_extract(text(c), r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def first_year(c: Column) -> Column:
    """First year 1900-2099 in a text, else null."""
    return F.nullif(F.regexp_extract(text(c), r"((?:19|20)[0-9]{2})", 1), F.lit("")).try_cast("int")


def present(c: Column) -> Column:
    """Whether a signal says anything."""
    return ~F.lower(text(c)).isin(*ABSENT)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round2(c: Column) -> Column:
    """Two decimals, ties upward, on the binary value."""
    return F.floor(c * 100 + 0.5) / 100


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 when there is nothing to share."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(F.try_divide(100.0 * part, whole) + 0.5)).cast("long")


def lcp_bucket(c: Column) -> Column:
    n = first_number(c)
    return F.when(n.isNull(), "ok").when(n < 2.5, "fast").when(n < 4, "ok").when(n < 6, "slow").otherwise("dire")
