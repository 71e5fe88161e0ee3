"""Records that are the same by any of several keys, and one record made of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.storage import Workspace


def components(keyed: DataFrame, work: Workspace) -> DataFrame:
    """``row`` and ``component``, the smallest row that is reached through shared keys, from ``keyed`` (row, key).

    A key is told by its smallest row, which is enough: keys that have it in common are linked by it. Only rows that share a key take part
    in the rounds. Labels go from rows to their keys and back, as minima, and then each row takes the label of the row that its own label
    names, so long chains take few rounds: about the logarithm of their length. Each round is two aggregates, combined before the shuffle,
    so that a key of very many rows is no single task's; no pair of rows is made. Null rows and keys link nothing and have no row in the result.
    """
    given = keyed.select("row", "key").where(F.col("row").isNotNull() & F.col("key").isNotNull())
    hubs = given.groupBy("key").agg(F.min("row").alias("hub"), F.max("row").alias("last")).where("hub <> last").select("key", "hub")
    edges = work.table(given.join(hubs, "key").select("row", "hub").distinct(), "edges")
    labels = work.table(edges.groupBy("row").agg(F.min("hub").alias("component")), "labels")
    while True:
        of_hub = work.table(edges.join(labels, "row").groupBy("hub").agg(F.min("component").alias("label"), F.max("component").alias("most")), "hubs")
        if of_hub.where("label <> most").isEmpty():
            break
        near = work.table(edges.join(of_hub, "hub").groupBy("row").agg(F.min("label").alias("near")), "near")
        far = near.select(F.col("row").alias("near"), F.col("near").alias("far"))
        labels = work.table(near.join(far, "near").select("row", F.least("near", "far").alias("component")), "labels")
    return given.select("row").distinct().join(labels, "row", "left").select("row", F.coalesce("component", "row").alias("component"))


def runs(df: DataFrame, row: str, same: list[Column], at: Column, days: int) -> DataFrame:
    """``row`` and ``key`` of rows that are alike in ``same``: a key, its first row, for each run whose neighbours in time are at most ``days`` apart.

    A window by what is alike splits no further, so ``same`` should be as narrow as records that could be the same are. Rows without time
    are one run, and rows that lack a value of ``same`` are in none.
    """
    names = [f"_same{i}" for i in range(len(same))]
    given = df.select(row, at.alias("_at"), *[c.alias(n) for c, n in zip(same, names, strict=True)]).dropna(subset=names)
    order = Window.partitionBy(*names).orderBy("_at", row)
    before = F.lag("_at").over(order)
    fresh = F.lag(row).over(order).isNull() | F.coalesce(F.datediff("_at", before) > days, F.col("_at").isNotNull() & before.isNull())
    start = F.last(F.when(fresh, F.col(row)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return given.withColumn("_start", start).select(row, F.concat(F.lit("run::"), F.col("_start").cast("string")).alias("key"))


def last_values(df: DataFrame, by: str, at: Column, order: str, fields: list[str], lists: list[str]) -> DataFrame:
    """One row for each ``by``: of each field the value of the latest row that has one, and of each list the distinct values of all rows.

    Of equally late rows the last in ``order`` counts; rows without a time are the earliest. Lists are sorted by first occurrence.
    """
    rank = F.struct(F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(-(1 << 62))), F.col(order))
    ranked = df.withColumn("_rank", rank)
    told = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in fields]
    found = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("first"), *told)
    for c in lists:
        each = ranked.select(by, order, F.posexplode(c).alias("_place", "_value")).where(F.col("_value").isNotNull())
        first = each.groupBy(by, "_value").agg(F.min(F.struct(order, "_place")).alias("_first"))
        joined = first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_value"))), lambda v: v["_value"]).alias(c))
        found = found.join(joined, by, "left").withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    return found


def deduplicated(df: DataFrame, row: str, key: Column, same: list[Column], at: Column, fields: list[str], lists: list[str], work: Workspace, days: int = 3) -> DataFrame:
    """One record for each group of rows of ``df`` that share ``key``, or agree in ``same`` with times at most ``days`` apart, directly or through others.

    A loop over the rows would send a new key to the record that an earlier, similar row opened, and so depend on the order of the rows. Here
    the group is what is linked in any order: two rows with one key are one record however far apart, and similar rows are one as long as no
    gap between neighbours is longer than ``days``. Fields are merged by ``last_values``. ``row`` numbers the rows, unique and not null.
    """
    keyed = df.select(F.col(row).alias("row"), F.concat(F.lit("key::"), key.cast("string")).alias("key"))
    similar = runs(df, row, same, at, days).withColumnRenamed(row, "row")
    found = components(keyed.unionByName(similar), work)
    placed = df.join(found.withColumnRenamed("row", row), row, "left").withColumn("component", F.coalesce("component", row))
    return last_values(placed, "component", at, row, fields, lists)
