"""Joins over alternative keys.

A record matches another if any of several keys agrees. As a condition with OR that is a nested loop; here each record
lists its keys, tagged by kind, the lists are exploded, and one equi-join answers all kinds at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tagged(*keys: tuple[str, Column]) -> Column:
    """Keys as ``kind:value``; those that are null or blank are left out."""
    return F.array_compact(F.array(*[F.when(F.trim(value.cast("string")) != "", F.concat(F.lit(kind + ":"), value.cast("string"))) for kind, value in keys]))


def any_key(left: DataFrame, right: DataFrame, row: str, keys: str = "keys") -> DataFrame:
    """Rows (``row`` names their id) of ``left`` that share a key with any row of ``right``: row and the kinds that agree."""
    own = left.select(row, F.explode(keys).alias("_key"))
    other = right.select(F.explode(keys).alias("_key")).distinct()
    kinds = F.array_sort(F.collect_set(F.substring_index("_key", ":", 1)))
    return own.join(other, "_key", "left_semi").groupBy(row).agg(kinds.alias("matched"))


def matched(left: DataFrame, right: DataFrame, row: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (``left_semi``) or without (``left_anti``) a key in common with ``right``."""
    return left.join(any_key(left, right, row).select(row), row, how)


def guard(incoming: DataFrame, archive: DataFrame, row: str, archive_row: str, weak: tuple[str, ...] = ("ot",)) -> DataFrame:
    """The first archived row (by id) that each incoming row matches by a key strong enough to block it.

    Keys of a weak kind never block alone. What was a set comparison of each with each is a hash join on keys. Of each key only the first
    archived row takes part, so that a key which many rows share makes no pairs of these.
    """
    strong = lambda df, name: df.select(name, F.explode("keys").alias("_key")).where(~F.substring_index("_key", ":", 1).isin(*weak))
    first = strong(archive, archive_row).groupBy("_key").agg(F.min(archive_row).alias(archive_row))
    met = strong(incoming, row).join(first, "_key")
    return met.groupBy(row).agg(F.min(archive_row).alias(archive_row), F.array_sort(F.collect_set(F.substring_index("_key", ":", 1))).alias("matched"))


def first_by_priority(left: DataFrame, right: DataFrame, row: str, right_row: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` that its first key finds, keys being listed by priority.

    Ties within a key go to the smallest ``right_row``, which alone stands for its key in the join. Rows without a match are left out.
    """
    own = left.select(row, F.posexplode("keys").alias("_priority", "_key"))
    other = right.select(right_row, F.explode("keys").alias("_key")).groupBy("_key").agg(F.min(right_row).alias(right_row))
    best = F.min(F.struct("_priority", right_row, "_key"))
    return own.join(other, "_key").groupBy(row).agg(best.alias("_b")).select(row, F.col(f"_b.{right_row}").alias(right_row), F.substring_index("_b._key", ":", 1).alias("method"))


def groups_of_duplicates(df: DataFrame, row: str, least: int = 2) -> DataFrame:
    """Keys that several rows share, with the number of rows and the smallest."""
    keyed = df.select(row, F.explode("keys").alias("key"))
    return keyed.groupBy("key").agg(F.countDistinct(row).alias("members"), F.min(row).alias("first")).where(F.col("members") >= least)


def near_pairs(df: DataFrame, row: str, same: list[str], at: str, days: int) -> DataFrame:
    """Pairs of rows that agree in ``same`` and lie at most ``days`` apart: an equi-join with a band as its residual."""
    a, b = df.select(*same, F.col(row).alias("a"), F.col(at).alias("_at")), df.select(*[F.col(c).alias(f"_{c}") for c in same], F.col(row).alias("b"), F.col(at).alias("_bt"))
    on = [F.col(c) == F.col(f"_{c}") for c in same] + [F.col("a") < F.col("b"), F.abs(F.datediff("_at", "_bt")) <= days]
    return a.join(b, on).select(*same, "a", "b", F.abs(F.datediff("_at", "_bt")).alias("days"))


def chains(df: DataFrame, same: list[str], at: str, row: str, days: int) -> DataFrame:
    """Rows in runs whose neighbours in time are at most ``days`` apart, with the first row of each run."""
    w = Window.partitionBy(*same).orderBy(at, row)
    fresh = F.when(F.datediff(F.col(at), F.lag(at).over(w)) <= days, 0).otherwise(1)
    marked = df.withColumn("_fresh", fresh).withColumn("chain", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("first_row", F.first(row).over(Window.partitionBy(*same, "chain").orderBy(at, row))).drop("_fresh")
