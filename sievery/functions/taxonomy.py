"""Ordered rules: the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievery.functions.values import let


def first_match(x: Column, rules: tuple[tuple[str, str], ...], otherwise: str | None = None) -> Column:
    """Label of the first (label, pattern) that matches the lower-cased text."""
    low, found = F.lower(F.coalesce(x, F.lit(""))), None
    for label, pattern in rules:
        found = F.when(low.rlike(pattern), label) if found is None else found.when(low.rlike(pattern), label)
    return found.otherwise(F.lit(otherwise))


def classify(sources: list[tuple[Column, str]], rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """Label and confidence from several texts in order: the first text with a match decides, with its confidence."""

    def told(text: Column, level: str) -> Column:
        return let(first_match(text, rules), lambda label: F.when(label.isNotNull(), F.struct(label.alias("label"), F.lit(level).alias("confidence"))))

    found = [told(text, level) for text, level in sources]
    return F.coalesce(*found, F.struct(F.lit(otherwise).alias("label"), F.lit("low").alias("confidence")))
