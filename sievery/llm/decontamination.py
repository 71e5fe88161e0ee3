"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so their Jaccard similarity says little. What counts is how much of an item a
document contains. An item is indexed by the smallest hashes of its shingles; items are partitioned by size, and the
number of minima grows with the size such that a document which contains the wanted share of an item cannot miss all of
them. Documents of any length are looked up shingle by shingle, and each candidate is verified on the whole sets.

An item of one to four words is one shingle of its own length, and documents are looked up by their runs of that length too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievery.llm.words import SHINGLE, blocks, release, runs, shingle_sets, shingles, small_batches
from sievery.storage import Workspace

#: Least share of an item's shingles, in hundredths.
PERCENT = 75
#: Shingles of all items up to which the index is broadcast (16 bytes each); beyond, it is joined.
BROADCAST = 2_000_000
#: What a text contains.
FOUND = "struct<items: array<bigint>, containment: double>"


def minima(size: int, percent: int = PERCENT) -> int:
    """Smallest hashes that index an item of the size partition of ``size``: 1, 2, 3-4, 5-8 ... shingles.

    A document with ``percent`` of the item lacks too few shingles to lack all of these.
    """
    largest = 1 << max(0, int(size - 1).bit_length())
    return min(size, largest * (100 - percent) // 100 + 1)


def item_sets(benchmark: DataFrame) -> DataFrame:
    """item_id, the distinct shingles of each item, by hash, and the words of a shingle; items without words have no row."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
            words = [min(int(n), SHINGLE) for block in blocks(batch.column(1)) for n in np.diff(block.first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(words, pa.int32())], ["item_id", "hashes", "words"])

    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(collect, "item_id long, hashes array<long>, words int").where(F.size("hashes") > 0).distinct()


def _index(spark: SparkSession, items: DataFrame, percent: int):
    """Item ids, their sets, the minima in order and the item of each, broadcast."""
    rows = sorted(items.collect())
    sets = [np.array(r["hashes"], dtype=np.int64).view(np.uint64) for r in rows]
    keys = [s[: minima(len(s), percent)] for s in sets]
    key = np.concatenate([*keys, np.zeros(0, np.uint64)])
    order = np.argsort(key, kind="stable")
    owner = np.repeat(np.arange(len(sets)), [len(k) for k in keys]).astype(np.int64)
    return spark.sparkContext.broadcast((np.array([r["item_id"] for r in rows], dtype=np.int64), sets, key[order], owner[order]))


def _short(items: DataFrame) -> tuple[int, ...]:
    """The lengths of shingles of items of fewer words than a shingle has."""
    return tuple(sorted(r[0] for r in items.where(F.col("words") < SHINGLE).select("words").distinct().collect()))


def _search_all(shared, percent: int, lengths: tuple[int, ...]):
    """A function of texts: the items in each and the largest share. Only texts go to Python, and rows wait in the JVM."""

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, sets, key, item = shared.value
        distinct, first = np.unique(key, return_index=True)
        last = np.append(first[1:], len(key))
        for texts in batches:
            hits, best = [], []
            for block in blocks(texts):
                looked = []
                for found, offsets in (shingles(block.hashes, block.first), *[runs(block.hashes, block.first, k) for k in lengths]):
                    at = np.minimum(np.searchsorted(distinct, found), max(len(distinct) - 1, 0))
                    matched = np.flatnonzero(distinct[at] == found) if len(distinct) else np.zeros(0, np.int64)
                    looked.append((found, offsets, at, matched, np.searchsorted(offsets, matched, side="right") - 1))
                for i in range(len(block.first) - 1):
                    mine = np.concatenate([at[matched[np.searchsorted(owner, i) : np.searchsorted(owner, i, side="right")]] for _, _, at, matched, owner in looked])
                    kept: dict[int, float] = {}
                    if len(mine):
                        own = np.unique(np.concatenate([found[offsets[i] : offsets[i + 1]] for found, offsets, *_ in looked]))
                        candidates = np.unique(np.concatenate([item[first[k] : last[k]] for k in np.unique(mine)]))
                        for c in candidates:
                            place = np.minimum(np.searchsorted(own, sets[c]), len(own) - 1)
                            share = int((own[place] == sets[c]).sum())
                            if 100 * share >= percent * len(sets[c]):
                                kept[int(ids[c])] = max(kept.get(int(ids[c]), 0.0), share / len(sets[c]))
                    hits.append(sorted(kept))
                    best.append(max(kept.values(), default=0.0))
            yield pa.StructArray.from_arrays([pa.array(hits, pa.list_(pa.int64())), pa.array(best, pa.float64())], ["items", "containment"])
        release()

    return F.arrow_udf(search, FOUND).asNondeterministic()


def _search_joined(docs: DataFrame, items: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """The same through joins on shingles, for an index that is too large to broadcast.

    Texts are taken apart once; of their shingles only those that some item has are written, with the number of their row.
    """
    rows = work.table(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")), "rows")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, found in zip(batch.column(0), shingle_sets(batch.column(1), lengths), strict=True):
                yield pa.RecordBatch.from_arrays([pa.repeat(key, len(found)), pa.array(found.view(np.int64))], ["key", "hash"])

    lengths = _short(items)
    sized = items.withColumns({"n": F.size("hashes"), "set": F.xxhash64("hashes")})
    sized = work.table(sized, "items")
    whole = sized.select("item_id", "set", F.explode("hashes").alias("hash"))
    with small_batches(docs.sparkSession):
        exploded = rows.select("key", F.col("row.text")).mapInArrow(explode, "key long, hash long")
        of_docs = work.table(exploded.join(whole.select("hash").distinct(), "hash", "left_semi"), "shingles")
    # As ``minima``: the largest size of the partition is the next power of two.
    largest = F.expr("if(n = 1, 1L, shiftleft(1L, length(bin(n - 1))))")
    minima_of = F.least(F.col("n"), F.floor(largest * (100 - percent) / 100) + 1).cast("int")
    signature = sized.select("item_id", "set", "n", F.explode(F.slice("hashes", F.lit(1), minima_of)).alias("hash"))
    candidates = of_docs.join(signature, "hash").select("key", "item_id", "set", "n").distinct()
    shared = candidates.join(whole, ["item_id", "set"]).join(of_docs, ["key", "hash"])
    hits = shared.groupBy("key", "item_id", "set", "n").agg(F.count(F.lit(1)).alias("share")).where(F.col("share") * 100 >= F.col("n") * percent)
    by_row = hits.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("share") / F.col("n")).alias("containment"))
    met = rows.join(work.table(by_row, "hits"), "key", "left")
    return met.select("row.*", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def search(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``items``, the ids of the items that the text contains, and ``containment``, the largest share.

    An item of fewer than five words is found wherever its words stand one after the other. Null and empty texts contain nothing,
    nor are null and empty items found. Columns of ``docs`` named items or containment are replaced, others are kept
    whatever their names. Rows are judged each for itself, repeated and null ids included, and texts of any length are
    read whole. No documents give no rows, and without items nothing is contained.
    """
    docs = docs.drop("items", "containment").withColumn("text", F.col("text").cast("string"))
    work = Workspace(docs.sparkSession)
    items = work.table(item_sets(benchmark), "items")
    if (items.agg(F.sum(F.size("hashes"))).first()[0] or 0) > broadcast:
        return _search_joined(docs, items, percent, work)
    found = _search_all(_index(docs.sparkSession, items, percent), percent, _short(items))
    met = docs.select(F.struct("*").alias("row"), found(F.col("text")).alias("found"))
    return met.select("row.*", "found.items", "found.containment")
