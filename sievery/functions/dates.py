"""Column builders for dates. Clocks are always passed in, as columns or literals, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_or(x: Column, default: Column) -> Column:
    """The date that the text starts with, or the default where it names none."""
    return F.coalesce(F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"), default)


def days_between(older: Column, newer: Column) -> Column:
    """Whole days, not below zero; zero where a time is missing."""
    seconds = F.timestamp_diff("SECOND", older, newer)
    return F.coalesce(F.greatest(F.floor(seconds / 86400), F.lit(0)), F.lit(0)).cast("long")


def add_days(x: Column, days: int) -> Column:
    return x + F.expr(f"INTERVAL {days} DAYS")


def deadline(x: Column) -> Column:
    """The date after "deadline", "apply by" or "closing date": a long date, else an ISO date, else null."""
    mark = "(?i)(?:deadline|apply by|closing date|closes)[^0-9A-Za-z]*(?:is |on |: )?"
    long_ = F.regexp_extract(x, mark + "([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1)
    iso = F.regexp_extract(x, mark + "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.coalesce(F.try_to_date(F.nullif(long_, F.lit("")), "MMMM d, yyyy"), F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"))


def long_date(x: Column) -> Column:
    return F.date_format(x, "MMMM d, yyyy")
