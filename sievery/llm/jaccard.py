"""N-gram Jaccard join: an exact metric-space join of shingle sets with pivots.

Jaccard distance is a metric, and two texts link at a distance of at most r = 1/4. Sets that share no shingle are at
distance 1, as far apart as can be, so the space is mostly empty and regions are found through shared shingles: of each
set, the shingles that come first in an order common to all are its prefix, and two sets within r share one of these.
The sets with a shingle in common form a region around a pivot:

* sets within r of the pivot are linked to it, and thereby to one another: no pair among them is needed;
* by the triangle inequality, a set at distance d from the pivot can only link to sets at d - r to d + r. Sets of the
  ball that lie within r of the nearest set outside it are boundary sets: they stay, replicated into the next round,
  while the others are done;
* sets outside the ball stay as well, and what stayed is divided again around new pivots, more of them each round,
  until no region is left that holds two sets not yet known to be connected. Sets that are connected already, through
  whatever links, are not compared. Regions of at most ``SMALL`` sets have all their sets as pivots, those of at most
  ``LARGE`` after the first round all that are outside the label of most of their sets. Pivots of larger regions are sets
  with the least share of shingles of their own, for the centre of many near copies is within r of most of them.

After the first round, two sets that can still link share a known number of regions at least, all of them large: they
meet only in a region that is early enough in the order of both, smaller regions first, for that number to follow, and
that is the first they share, as far as the ``FIRST_REGIONS`` first of each tell. Of each set an odd sketch is kept, the parities of its shingles in each of ``SKETCH`` bins. Sets differ in as many shingles
as their sketches do in bins, or more, so a pair whose sketches differ too much cannot link. Neither loses a link.

Equal sets are one. Regions are rows, never lists, and a pivot meets its region by a join. Only shingles that are not
frequent are dealt by shingle alone; the regions of frequent ones are dealt by shingle and set, and aggregated in parts
or joined with what Spark can split. The order of the shingles puts frequent ones last, as seen in a sample of the texts. It affects the size of regions
only: whatever the order, every link is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.llm.words import mix, release, shingle_sets, small_batches
from sievery.storage import Workspace, broadcast_if_small

#: Least similarity, in hundredths of the union.
PERCENT = 75
#: Regions of at most so many sets are compared pair by pair, in the first round and in later ones.
SMALL = 8
LARGE = 4096
#: One text of so many, by the hash of its id, is looked at for frequent shingles; those in so many of them or more come last, up to a number.
SAMPLE = 16
FREQUENT = 4
MOST_FREQUENT = 1 << 20
#: Bins of an odd sketch, a multiple of 64, and the columns that hold it.
SKETCH = 256
BINS = [f"bins{i}" for i in range(SKETCH // 64)]
#: Bytes of sets that a Python worker holds before it passes them on.
SETS_HELD = 1 << 22
#: Ids that a broadcast table may hold (16 bytes each).
IDS_BROADCAST = 1_000_000
#: Of each set, its first regions that are told to the others, so that a pair that shares several is made in the first.
FIRST_REGIONS = 16


def set_key(found: np.ndarray) -> int:
    """A number for a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.uint64(len(found)) + mix(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)[0])


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """The parities of the number of shingles in each bin, as 64-bit words."""
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """Shingles that two linked sets cannot both do without: all but one fewer than they share at least."""
    return size - -(-size * percent // 100) + 1


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """Shingles that two linked sets of sizes n and m share at least."""
    return F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)


def _least_in_prefixes(n: Column, m: Column, percent: int) -> Column:
    """Shingles that the prefixes of two linked sets of sizes n and m share at least.

    What the sets share outside the prefixes lies beyond the prefix of the one whose prefix ends first.
    """
    return _least_shared(n, m, percent) - (F.ceil(F.greatest(n, m) * percent / F.lit(100) - 1e-9) - 1)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles that are frequent in a sample of ``docs`` (doc_id, text), ascending."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in shingle_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.monotonically_increasing_id(), F.lit(SAMPLE)) == 0).select(F.col("text").cast("string"))
    counts = some.mapInArrow(explode, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toPandas()
    return np.sort(rows["h"].to_numpy().view(np.uint64))


def _describe(frequent, percent: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        seen: set[int] = set()
        for batch in batches:
            keys, sizes, sketches, odd, rare, common = [], [], [], [], [], []
            for doc_id, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                key = set_key(found)
                keys.append(key)
                sizes.append(len(found))
                sketches.append(odd_sketch(found))
                odd.append(0)
                if doc_id is None or not len(found) or key in seen:
                    rare.append(np.zeros(0, np.int64))
                    common.append(rare[-1])
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(key)
                late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found if len(last) else np.zeros(len(found), bool)
                odd[-1] = 1000 * int((~late).sum()) // len(found)
                length = prefix_length(len(found), percent)
                rare.append(found[~late][:length].view(np.int64))
                common.append(found[late][: length - len(rare[-1])].view(np.int64))
            words = np.array(sketches, np.int64).reshape(-1, len(BINS)).T
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rare, common)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (keys, sizes, odd)], *lists, *[pa.array(x) for x in words]], ["doc_id", "key", "n", "odd", "rare", "common", *BINS])
        release()

    return describe


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sets, held = [], [], 0
        for i, found in enumerate(shingle_sets(batch.column(0))):
            keys.append(set_key(found))
            sets.append(found.tobytes())
            held += len(sets[-1])
            if held > SETS_HELD or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "shingles"])
                keys, sets, held = [], [], 0
    release()


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, sizes = [], ([], [])
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            sizes[0].append(len(a))
            sizes[1].append(len(b))
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            shared.append(int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in (shared, *sizes)]], ["pivot", "key", "shared", "pivot_n", "n"])
    release()


def connected(edges: DataFrame, work: Workspace) -> DataFrame:
    """key and label, the smallest key of its component, for the ends of ``edges`` (a, b), by label propagation with pointer jumping."""
    both = work.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = work.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "key"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["key"] == near["a"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = lower.select(F.col("key").alias("k"), F.col("label").alias("up"))
        jumped = lower.join(up, lower["label"] == up["k"], "left").select("key", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        done = work.table(jumped, "labels")
        labels = done.select("key", "label")
        if done.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def labelled(df: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    """``df`` with the label of the set in ``column``: itself where nothing is linked to it."""
    if labels is None:
        return df.withColumn(name, F.col(column))
    known = labels.select(F.col("key").alias(column), F.col("label").alias(name))
    return df.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def merged(labels: DataFrame | None, links: DataFrame, work: Workspace) -> DataFrame | None:
    """``labels`` after more ``links`` (pivot, key). Only links between different labels count, each pair of labels once."""
    ends = labelled(labelled(links, labels, "pivot", "a"), labels, "key", "b").where("a <> b")
    edges = work.table(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return labels
    moved = connected(edges, work)
    if labels is None:
        return moved
    to = moved.select(F.col("key").alias("label"), F.col("label").alias("to"))
    old = labels.join(to, "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    return work.table(old.unionByName(moved.join(labels.select("key"), "key", "left_anti")), "labels")


def _counted(members: DataFrame) -> DataFrame:
    """Members of regions (h) that hold several sets, with the number of these."""
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return members.join(sizes, "h")


def _as_pivots(columns: list[str], of: str = "") -> list[Column]:
    return [F.col(of + x).alias("pivot" if x == "key" else f"pivot_{x}") for x in columns]


def _pivots(members: DataFrame, pivots: int, columns: list[str]) -> DataFrame:
    """Of each region, ``pivots`` sets, the first of so many parts by hash: h, the columns as ``pivot`` (the key) and ``pivot_...``, and ``first``, true for one of them.

    Sets with the least share of shingles of their own come first: the centre of many near copies is nearer to each than most are to one another.
    """
    hashed = F.xxhash64("key")
    turn = F.struct("odd", hashed.alias("hash"))
    parts = members.groupBy("h", F.pmod(hashed, F.lit(pivots)).alias("part")).agg(F.min(F.struct(turn.alias("turn_"), *columns)).alias("p"))
    least = parts.groupBy("h").agg(F.min("p.turn_").alias("least"))
    return parts.join(least, "h").select("h", *_as_pivots(columns, "p."), (F.col("p.turn_") == F.col("least")).alias("first"))


def _with_turns(members: DataFrame, described: DataFrame) -> DataFrame:
    """Members with the number of regions that their set is in (``held``), their turn among them, smaller regions first, the first regions ``before`` theirs, and its sketch."""
    own = Window.partitionBy("key")
    turns = members.withColumn("held", F.count(F.lit(1)).over(own)).withColumn("turn", F.row_number().over(own.orderBy("members", "h")))
    sketches = described.join(members.select("key").distinct(), "key", "left_semi").select("key", *BINS).dropDuplicates(["key"])
    first = turns.where(F.col("turn") <= FIRST_REGIONS).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", "h")))["h"].alias("first"))
    before = F.slice("first", F.lit(1), F.least(F.col("turn") - 1, F.lit(FIRST_REGIONS)))
    return turns.join(first, "key").withColumn("before", before).drop("first").join(sketches, "key")


def _with_most(members: DataFrame, whole: int) -> DataFrame:
    """Members with ``main``, the label of most sets of their region, if it has at most ``whole``."""
    counts = members.where(F.col("members") <= whole).groupBy("h", "label").agg(F.count(F.lit(1)).alias("sets"))
    return members.join(counts.groupBy("h").agg(F.max_by("label", F.struct("sets", "label")).alias("main")), "h", "left")


def _differing_bins() -> Column:
    """Bins in which the sketches of a set and of its pivot differ: at least so many shingles are in one of them only."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"pivot_{x}"))) for x in BINS), F.lit(0))


class _Distances:
    """Exact distances between sets, computed once for each pair."""

    def __init__(self, docs: DataFrame, described: DataFrame, work: Workspace, percent: int):
        self.docs, self.described, self.work, self.percent = docs, described, work, percent

    def of(self, pairs: DataFrame) -> DataFrame:
        """pivot, key, shared, the size of the intersection, pivot_n and n, those of the sets, for pairs (pivot, key)."""
        pairs = self.work.table(pairs, "pairs")
        keys = pairs.select(F.col("pivot").alias("key")).union(pairs.select("key")).distinct()
        ids = self.described.where(F.col("doc_id").isNotNull()).join(broadcast_if_small(keys, IDS_BROADCAST), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
        ids = broadcast_if_small(self.work.table(ids, "ids"), IDS_BROADCAST)
        texts = self.docs.join(ids, "doc_id", "left_semi").select("text")
        with small_batches(texts.sparkSession):
            sets = self.work.table(texts.mapInArrow(_sets, "key long, shingles binary"), "sets")
        # Pairs are thin: broadcast while they are few, they meet the sets of their pivots without a shuffle of sets.
        with_pivot = sets.select(F.col("key").alias("pivot"), F.col("shingles").alias("a")).join(broadcast_if_small(pairs, IDS_BROADCAST), "pivot")
        others = sets.join(broadcast_if_small(pairs.select("key").distinct(), IDS_BROADCAST), "key", "left_semi")
        met = with_pivot.join(others.withColumnRenamed("shingles", "b"), "key").select("pivot", "key", "a", "b")
        with small_batches(met.sparkSession):
            return self.work.table(met.mapInArrow(_intersect, "pivot long, key long, shared long, pivot_n long, n long").distinct(), "distances")


def components(docs: DataFrame, work: Workspace, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    A component holds the texts that are reachable by links (``100 * intersection >= percent * union``), and its id is
    the smallest doc_id among them. A null or empty text, or one without words, has no shingles and is a component of
    its own rows' id. A row without doc_id counts its shingles but links nothing; it has the component of the texts equal to its own,
    or null. Rows that repeat an id belong to the component of their own text. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))
    with small_batches(spark):
        described = work.table(docs.mapInArrow(_describe(frequent, percent), "doc_id long, key long, n long, odd long, rare array<long>, common array<long>, " + ", ".join(f"{x} long" for x in BINS)), "described")
    # Frequent shingles are dealt by shingle and set, the others by shingle alone, which saves a shuffle.
    # Size and share of own shingles travel as one number, for there are many rows here.
    size = (F.col("n") * 1024 + F.col("odd")).alias("size")
    rare = _counted(described.select("key", size, F.explode("rare").alias("h")).repartition("h").distinct())
    common = _counted(described.select("key", size, F.explode("common").alias("h")).distinct())
    told = rare.unionByName(common).withColumns({"n": F.shiftright("size", 10), "odd": F.col("size").bitwiseAND(1023), "label": F.col("key")})
    members = work.table(told.drop("size"), "members")
    # Far apart in size is far apart: the distance is at least 1 - smaller / larger.
    close = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    distances, known, labels = _Distances(docs, described, work, percent), None, None
    # Of each set, in how many large regions it is: more shingles than these two sets cannot share unseen.
    large = work.table(members.where(F.col("members") > SMALL).groupBy("key").agg(F.count(F.lit(1)).alias("large")), "large")
    pivots, whole, turns = 1, SMALL, []
    while not members.isEmpty():
        columns = ["key", "n", "label", *turns]
        picked = work.table(_pivots(members.where(F.col("members") > whole), pivots, columns), "pivots")
        # Of two sets that are not connected one at least is outside the main label of their region: only those are pivots.
        every = _with_most(members, whole) if turns else members.withColumn("main", F.lit(None).cast("long"))
        head = every.where((F.col("members") <= whole) & ~F.col("label").eqNullSafe(F.col("main"))).select("h", *_as_pivots(columns)).unionByName(picked.drop("first"))
        # Each pair once: its smaller key is the pivot, where both may be one.
        other = (F.col("key") > F.col("pivot")) | (F.col("members") > whole) & (F.col("key") < F.col("pivot")) | F.col("label").eqNullSafe(F.col("main"))
        met = every.join(head, "h").where(other & (F.col("label") != F.col("pivot_label")) & close)
        pair = [F.least("pivot", "key").alias("pivot"), F.greatest("pivot", "key").alias("key")]
        needed = _least_in_prefixes(F.col("n"), F.col("pivot_n"), percent)
        if not turns:
            small = F.count(F.when(F.col("members") <= SMALL, 1)).alias("small")
            wanted = met.groupBy(*pair, needed.alias("needed")).agg(small)
            wanted = wanted.join(large, "key", "left").join(large.select(F.col("key").alias("pivot"), F.col("large").alias("pivot_large")), "pivot", "left")
            most = F.col("small") + F.least(F.coalesce("large", F.lit(0)), F.coalesce("pivot_large", F.lit(0)))
            wanted = wanted.withColumn("most", most).where(F.col("most") >= F.col("needed"))
        else:
            # Pairs that share a small region have been compared: all regions that these share are among those held.
            early = (F.col("turn") + needed - 1 <= F.col("held")) & (F.col("pivot_turn") + needed - 1 <= F.col("pivot_held"))
            near = _differing_bins() <= F.col("n") + F.col("pivot_n") - 2 * _least_shared(F.col("n"), F.col("pivot_n"), percent)
            # A pair is made in the first region that it shares.
            once = ~F.arrays_overlap("before", "pivot_before")
            wanted = met.where(early & near & once).withColumn("most", -_differing_bins()).groupBy(*pair).agg(F.max("most").alias("most"))
        wanted = work.table(wanted.select("pivot", "key", "most"), "wanted")
        # In the first round, the likeliest pivot of each set comes first; then only the pairs that this has left apart.
        for likeliest in (True, False) if not turns else (False,):
            pairs = wanted if known is None else wanted.join(known.select("pivot", "key"), ["pivot", "key"], "left_anti")
            if likeliest:
                pairs = pairs.groupBy("key").agg(F.max_by("pivot", F.struct("most", "pivot")).alias("pivot"))
            pairs = labelled(labelled(pairs, labels, "pivot", "a"), labels, "key", "b").where("a <> b")
            found = distances.of(pairs.select("pivot", "key"))
            known = found if known is None else work.table(known.unionByName(found), "known")
            linked = F.col("shared") * 100 >= (F.col("n") + F.col("pivot_n") - F.col("shared")) * percent
            labels = merged(labels, found.where(linked).select("pivot", "key"), work)
        # Regions whose sets are all connected are done, as are those compared pair by pair, and sets that were pivots.
        rest = members.where(F.col("members") > whole).drop("label", "members").join(picked.select("h", F.col("pivot").alias("key")), ["h", "key"], "left_anti")
        rest = labelled(rest, labels, "key", "label")
        apart = rest.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
        rest = work.table(rest.join(apart, "h", "left_semi"), "rest")
        if rest.isEmpty():
            break
        # Distance of each that is left to the first pivot of its region, or the least that its size and sketch allow.
        first = labelled(picked.where("first").drop("first", "pivot_label"), labels, "pivot", "pivot_label")
        met = rest.join(first, "h").withColumns({"low": F.least("pivot", "key"), "high": F.greatest("pivot", "key")})
        met = met.join(known.select(F.col("pivot").alias("low"), F.col("key").alias("high"), "shared"), ["low", "high"], "left")
        union = F.col("n") + F.col("pivot_n") - F.col("shared")
        most = F.least("n", "pivot_n")
        if turns:
            most = F.least(most, (F.col("n") + F.col("pivot_n") - _differing_bins()) / 2)
        distance = F.coalesce(1 - F.col("shared") / union, 1 - most / (F.col("n") + F.col("pivot_n") - most))
        radius = (100 - percent) / 100 + 1e-9
        inside = F.coalesce(F.col("shared") * 100 >= union * percent, F.lit(False))
        met = met.select("h", "key", distance.alias("distance"), inside.alias("inside"), (F.col("label") != F.col("pivot_label")).alias("foreign"))
        # Sets that are connected to the pivot need no link to one another; the others must be out of reach.
        nearest = met.where("foreign").groupBy("h").agg(F.min("distance").alias("nearest"))
        settled = met.where("inside").join(nearest, "h", "left").where(F.col("nearest").isNull() | (F.col("nearest") - F.col("distance") > radius))
        members = _counted(rest.join(settled.select("h", "key"), ["h", "key"], "left_anti"))
        if not turns:
            members, turns = _with_turns(members, described), ["turn", "held", "before", *BINS]
        members = work.table(members, "members")
        pivots, whole = pivots * SMALL, LARGE
    thin = described.select("doc_id", "key", "n")
    if labels is not None:
        thin = thin.join(labels, "key", "left")
        group = F.coalesce("label", "key")
    else:
        group = F.col("key")
    thin = work.table(thin.withColumn("group", group).select("doc_id", "n", "group"), "grouped")
    smallest = thin.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("component"))
    joined = thin.join(smallest, "group", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
