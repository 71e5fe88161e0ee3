"""Checks as findings: each check is a condition, a finding a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(df: DataFrame, row: str, checks: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each check that a record fails: the columns kept, ``row`` and ``check``. One pass, no union of scans."""
    failed = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in checks.items()]))
    return df.select(*keep, row, F.explode(failed).alias("check"))


def totals(found: DataFrame, by: str) -> DataFrame:
    """Findings by check and group, with totals of each and of all (null stands for all)."""
    return found.rollup("check", by).agg(F.count(F.lit(1)).alias("n"))


def sample(found: DataFrame, row: str, most: int = 10) -> DataFrame:
    """The first rows of each check, and how many there are."""
    from sievery.operators.windows import top_each

    counts = found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    first = top_each(found, ["check"], [row], most, "place")
    return first.groupBy("check").agg(F.sort_array(F.collect_list(row)).alias("rows")).join(counts, "check")


def drift(previous: DataFrame, current: DataFrame, tolerance: float) -> DataFrame:
    """Metrics (metric, value) of two runs, their change, and whether it is beyond the tolerance."""
    a, b = previous.select("metric", F.col("value").alias("before")), current.select("metric", F.col("value").alias("after"))
    met = a.join(b, "metric", "full_outer")
    change = F.when(F.col("before") == 0, None).otherwise((F.col("after") - F.col("before")) / F.col("before"))
    return met.withColumn("change", change).withColumn("alert", F.coalesce(F.abs("change") > tolerance, F.lit(True)))


#: Examples that a count keeps.
EXAMPLES = 10


def counted(found: DataFrame, by: list[str], id_: str, **others: Column) -> DataFrame:
    """Groups of ``found`` with ``n``, sums ``others``, and up to ten ids as ``examples``, however large a group is.

    Ids fall into sixteen parts by their MD5, and each part keeps its smallest: sixteen rows of a group are all that is
    ever gathered, and they are combined before the shuffle. Rows without id count but are no example.
    """
    key = F.col(id_).cast("string")
    parts = found.withColumn("_part", F.substring(F.md5(key.cast("binary")), 1, 1)).groupBy(*by, "_part")
    parts = parts.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("_first"), *[F.sum(c).alias(name) for name, c in others.items()])
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in others], F.slice(F.array_sort(F.collect_list("_first")), 1, EXAMPLES).alias("examples"))
