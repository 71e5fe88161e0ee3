"""Reports on a public board: its diversity, its health, and what an archive would stop. Counts are aggregates, never lists on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.operators import keys

#: Statuses of records that an archive keeps.
ARCHIVED = ("archived", "rejected", "removed", "expired", "hidden", "closed")


def shares(df: DataFrame, by: str, least: int = 0) -> DataFrame:
    """Rows and share of each value, of those with more than ``least`` rows; the total is one more aggregate of one row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return counts.join(F.broadcast(total)).select(by, "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


def areas(df: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """How many rows belong to each area; a row may belong to several, and areas without rows count 0."""
    counts = df.agg(*[F.count_if(F.coalesce(F.lower(text).rlike(p), F.lit(False))).alias(name) for name, p in patterns.items()])
    return counts.unpivot([], list(patterns), "area", "n")


def waiting_elsewhere(public: DataFrame, pending: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Values of pending rows that the public board lacks, with their number and the first titles."""
    missing = pending.join(public.select(by).distinct(), by, "left_anti").where(F.col(by).isNotNull())
    return missing.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("example")).where(F.col("n") >= least)


def health(public: DataFrame, pending: DataFrame, published_ids: DataFrame, broad: Column, expected: DataFrame, organization: str = "organization", small: int = 30, smallest: int = 20, least_organizations: int = 15) -> DataFrame:
    """level, check and n of what is wrong with a board; an empty result is a healthy one.

    Each check is an aggregate of one row: sizes, published records that are gone, organisations that should be there,
    too much of one kind of source, and records whose text shows a parser's fault. ``broad`` is over ``pending``.
    """
    one = public.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.lower(organization)).alias("organizations"),
        F.count_if((F.col("salary") != "") & ~F.col("salary").rlike("[$£€]")).alias("unsigned"),
        F.count_if(F.col("description").rlike(r"^\)\s*[A-Z]")).alias("broken"),
    )
    other = pending.agg(F.count(F.lit(1)).alias("pending"), F.count_if(broad).alias("broad"))
    gone = published_ids.join(public.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("gone"))
    absent = expected.join(public.select(F.lower(organization).alias("name")).distinct(), "name", "left_anti").agg(F.count(F.lit(1)).alias("absent"))
    row = one.join(F.broadcast(other)).join(F.broadcast(gone)).join(F.broadcast(absent))
    checks = [
        ("failure", "critically_few", "rows", F.col("rows") < smallest),
        ("warning", "few", "rows", F.col("rows") < small),
        ("failure", "published_missing", "gone", F.col("gone") > 0),
        ("warning", "expected_missing", "absent", F.col("absent") > 0),
        ("warning", "broad_sources", "broad", F.col("broad") > F.col("pending") * 0.4),
        ("warning", "pay_without_currency", "unsigned", F.col("unsigned") > 0),
        ("failure", "broken_opening", "broken", F.col("broken") > 0),
        ("warning", "few_organizations", "organizations", F.col("organizations") < least_organizations),
    ]
    told = [F.when(c, F.struct(F.lit(level).alias("level"), F.lit(name).alias("check"), F.col(n).cast("long").alias("n"))) for level, name, n, c in checks]
    return row.select(F.explode(F.array_compact(F.array(*told))).alias("f")).select("f.*")


def archive_of(records: DataFrame, fingerprint: Column, statuses: tuple[str, ...] = ARCHIVED) -> DataFrame:
    """Records that count as archived and have a key, with ``keys``."""
    return records.where(F.lower("status").isin(*statuses)).withColumn("keys", fingerprint).where(F.size("keys") > 0)


def guard_diagnostics(tables: dict[str, DataFrame], archive: DataFrame, row: str, archive_row: str) -> DataFrame:
    """Of each table (with ``keys``), how many rows the archive would stop, by the kinds of keys that agree."""
    out = None
    for name, table in tables.items():
        found = keys.guard(table, archive, row, archive_row).select(F.lit(name).alias("dataset"), F.array_join("matched", ",").alias("matched"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("dataset", "matched").agg(F.count(F.lit(1)).alias("n"))
