"""Counts, rates, histograms, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, key: Column, most: int = 20) -> DataFrame:
    """The most frequent values, ties by name; blank ones don't count."""
    return count_by(df.where(F.trim(key.cast("string")) != ""), key).orderBy(F.desc("n"), "key").limit(most)


def histogram(df: DataFrame, score: Column, bins: tuple[tuple[str, int, int], ...]) -> DataFrame:
    """Counts of whole scores in named bins, zero for bins without rows."""
    spark = df.sparkSession
    bin_of = F.lit(None).cast("string")
    for name, low, high in bins:
        bin_of = F.coalesce(bin_of, F.when(score.between(low, high), name))
    counted = df.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(b[0],) for b in bins], "bin string")
    return names.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` as columns and their total, missing ones zero."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    filled = wide.select(row, *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values])
    return filled.withColumn("total", sum((F.col(v) for v in values), F.lit(0)).cast("long"))


def duplicates(*key: str) -> Column:
    """How many rows of a group are beyond the first with their key; rows with a null in the key don't count."""
    return F.count(F.when(sum((F.col(k).isNull().cast("int") for k in key), F.lit(0)) == 0, 1)) - F.countDistinct(*key)


def reason_counts(df: DataFrame, by: str, reasons: str) -> DataFrame:
    """How often each reason occurs, by group."""
    return df.select(by, F.explode(reasons).alias("reason")).groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n"))


def source_score(rates: dict[str, Column], penalties: dict[str, Column], bonus: Column) -> Column:
    """Weighted quality of a source, 0 to 100. Fixed weights: rates in hundredths, penalties for each occurrence."""
    weights = {"parsed": 0.20, "described": 0.15, "paid": 0.20, "linked": 0.10}
    costs = {"stale": 3, "duplicates": 5, "archived": 10, "manual": 2}
    total = bonus
    for name, x in rates.items():
        total = total + x * weights[name]
    for name, x in penalties.items():
        total = total - x * costs[name]
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(total + 0.5))).cast("long")


def tier(score: Column, volume: Column) -> Column:
    """Tier and recommendation from score and volume."""
    pair = lambda t, r: F.struct(F.lit(t).alias("tier"), r.alias("recommendation"))
    return (
        F.when((score >= 80) & (volume >= 3), pair("highest_quality", F.lit("KEEP")))
        .when(score >= 60, pair("medium_quality", F.when(volume > 0, "HARDEN").otherwise("KEEP")))
        .when(score >= 30, pair("high_maintenance", F.when(volume >= 5, "MANUAL_REVIEW_ONLY").otherwise("HARDEN")))
        .otherwise(pair("candidate_for_removal", F.when(volume > 0, "HARDEN").otherwise("REMOVE")))
    )
