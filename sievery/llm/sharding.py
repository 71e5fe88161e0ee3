"""Sharding by longest processing time: groups of equal texts, largest first, each to the least loaded shard.

A heap over all groups would be a loop over the corpus. Groups are therefore heavy or light: a heavy one has at least
one part in ``BUNDLES`` of all bytes, so there are at most that many, and the light ones go together in bundles by the
hash of their text, at most that many as well. The heap deals heavy groups and bundles, and what the driver sees is
bounded whatever the corpus. In a small corpus all groups are heavy; in a large one the shards differ by less than the
lightest of what the heap deals last, a few parts in ``BUNDLES``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.storage import Workspace

SHARDS = 16
CELLS = 1024
#: Heavy groups and bundles of light ones that the driver deals, at most so many of each (50 bytes a row).
BUNDLES = 1 << 16


def dense_rank_in(df: DataFrame, keys: list[str], spread: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... among the rows with equal ``keys``, without a task for each key's rows.

    Rows are spread over cells by a hash; counts of the cells give each cell its offset.
    """
    cells = df.withColumn("_cell", F.pmod(F.xxhash64(*spread), F.lit(CELLS)))
    counts = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cells.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)) - 1)
    return ranked.join(offsets, [*keys, "_cell"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_cell", "_rank", "_before")


def longest_first(weights: list[int], shards: int) -> list[int]:
    """The shard of each weight: heaviest first, ties in the order given, each to the least loaded shard."""
    heap, homes = [(0, s) for s in range(shards)], [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: -weights[i]):
        load, home = heap[0]
        homes[i] = home
        heapq.heapreplace(heap, (load + weights[i], home))
    return homes


def shard(docs: DataFrame, work: Workspace, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of ``docs`` (doc_id, text).

    Law ``bytes``: sizes (UTF-8 bytes and 1) of the shards are near equal, and equal texts share a shard. A null text
    counts as an empty one. Rows with null or repeated doc_id are placed like any other. ``slot`` counts from 0 in each
    shard. An empty table gives an empty table. A very long text is a heavy group of its own. Other columns are dropped.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.md5(data)).alias("digest"))
    thin = work.table(thin, "thin")
    unit = -(-(thin.agg(F.sum("size")).first()[0] or 1) // bundles)
    groups = work.table(thin.groupBy("digest").agg(F.sum("size").alias("weight")), "groups")
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles))
    heavy = groups.where(F.col("weight") >= unit).select("digest", F.lit(None).cast("long").alias("bundle"), "weight")
    light = groups.where(F.col("weight") < unit).groupBy(bundle.alias("bundle")).agg(F.sum("weight").alias("weight")).select(F.lit(None).cast("binary").alias("digest"), "bundle", "weight")
    dealt = sorted((tuple(r) for r in heavy.unionByName(light).collect()), key=lambda r: (r[0] is None, r[0] or b"", r[1] or 0))
    homes = longest_first([r[2] for r in dealt], shards)
    homes = spark.createDataFrame([(bytes(d) if d is not None else None, b, h) for (d, b, _), h in zip(dealt, homes, strict=True)], "digest binary, bundle long, shard int")
    own = F.broadcast(homes.where(F.col("digest").isNotNull()).select("digest", F.col("shard").alias("own")))
    shared = F.broadcast(homes.where(F.col("digest").isNull()).select("bundle", F.col("shard").alias("shared")))
    placed = thin.withColumn("bundle", bundle).join(own, "digest", "left").join(shared, "bundle", "left")
    placed = work.table(placed.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard")), "dealt")
    return dense_rank_in(placed, ["shard"], ["doc_id", "text_crc32"], ["doc_id", "text_crc32", "size"], "slot")
