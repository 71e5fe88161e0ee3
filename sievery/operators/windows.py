"""Window-shaped operators: decisions that depend on the rows before. Every order ends in a key that is unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Order = list[Column | str]


def keep_first(df: DataFrame, by: list[str], order: Order) -> DataFrame:
    """The first row of each group in the given order; rows only for the group's own task, cut before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def mark_repeats(df: DataFrame, by: list[str], order: Order, row: str) -> DataFrame:
    """Rows that repeat an earlier one, with the first row of their group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("first_row", F.first(row).over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def top_each(df: DataFrame, by: list[str], order: Order, most: int, place: str = "place") -> DataFrame:
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= most)


def quota(df: DataFrame, source: str, order: Order, limited: Column, limited_most: int, source_most: int, total_most: int | None = None, first: Column | None = None) -> DataFrame:
    """Greedy quotas, in two passes and a total.

    Going down the order, a source may place ``source_most`` rows, of which at most ``limited_most`` are ``limited``.
    A full source rejects everything after, so the greedy loop equals: rank the limited rows of each source and drop
    those beyond their cap, then rank what is left and drop those beyond the source's. Rows of ``first`` are exempt
    from both and come first in the total.
    """
    exempt = F.coalesce(first, F.lit(False)) if first is not None else F.lit(False)
    marked = df.withColumns({"_exempt": exempt, "_limited": limited})
    w = Window.partitionBy(source, "_exempt", "_limited").orderBy(*order)
    one = marked.withColumn("_n", F.row_number().over(w)).where(F.col("_exempt") | ~F.col("_limited") | (F.col("_n") <= limited_most))
    two = one.withColumn("_n", F.row_number().over(Window.partitionBy(source, "_exempt").orderBy(*order))).where(F.col("_exempt") | (F.col("_n") <= source_most))
    if total_most is not None:
        two = two.orderBy(F.desc("_exempt"), *order).limit(total_most)
    return two.drop("_n", "_exempt", "_limited")


def base_and_overflow(df: DataFrame, by: list[str], order: Order, base: int, high: Column, slots: int) -> DataFrame:
    """Slot of each row: the first ``base`` of a group, then up to ``slots`` of the high ones beyond, else backlog."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = df.withColumn("_n", F.row_number().over(w))
    beyond = F.when((F.col("_n") > base) & high, 1).otherwise(0)
    used = F.sum(beyond).over(w.rowsBetween(Window.unboundedPreceding, 0))
    slot = F.when(F.col("_n") <= base, "base").when(high & (used <= slots), "overflow").otherwise("backlog")
    return placed.withColumn("slot", slot).drop("_n")


def each_then_all(df: DataFrame, by: str, order: Order, each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group, then the first ``total`` of all."""
    return top_each(df, [by], order, each, "_n").drop("_n").orderBy(*order).limit(total)


def running_seen(df: DataFrame, key: str, order: Order, kept: Column) -> DataFrame:
    """``repeat``: whether an earlier row with the same key would have been kept. Rejected rows leave no trace."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("repeat", F.coalesce(F.max(kept.cast("int")).over(before), F.lit(0)) == 1)


def streaks(df: DataFrame, by: list[str], order: Order, failed: Column) -> DataFrame:
    """``streak``: failures up to each row since the last success."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = df.withColumns({"_failed": failed.cast("int")}).withColumn("_run", F.sum(1 - F.col("_failed")).over(w))
    inner = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("streak", F.sum("_failed").over(inner)).drop("_failed", "_run")


def neighbours(df: DataFrame, order: Order, row: str, by: list[str]) -> DataFrame:
    """The rows before and after within a group; ``by`` names at least one column, for without groups all rows would pass through one task."""
    if not by:
        raise ValueError("neighbours are those of a group: name its columns")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"previous": F.lag(row).over(w), "following": F.lead(row).over(w)})


def unique_slugs(df: DataFrame, slug: str, suffix: str, order: Order) -> DataFrame:
    """``unique_slug``: the slug for its first row, then the slug with the row's suffix, then numbered from 2.

    A suffixed slug that is another row's base slug, or another's suffixed one, gets a number as well.
    """
    w = Window.partitionBy(slug).orderBy(*order)
    named = df.withColumn("_n", F.row_number().over(w)).withColumn("_with", F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, suffix)))
    again = Window.partitionBy("_with").orderBy((F.col("_n") > 1).cast("int"), *order)
    counted = named.withColumn("_m", F.row_number().over(again))
    return counted.withColumn("unique_slug", F.when(F.col("_m") == 1, F.col("_with")).otherwise(F.concat_ws("-", "_with", F.col("_m").cast("string")))).drop("_n", "_m", "_with")
