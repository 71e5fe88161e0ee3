"""Mixing sources to target weights by pivotal dependent rounding.

Each document should be taken ``target / source size`` times, a number that is rarely whole. Pivotal rounding makes it
whole without moving the total: two documents with fractional parts meet, a random transfer of words from one to the
other makes one of them whole, and the other goes on with what is left of both. Transfers are weighted by size, so the
words (not only the copies) of a source are kept at every meeting, and each document's expectation too. The meetings
form a tree with a bounded fan-in: documents of a source in small leaves, then the one residual of each leaf with those
of its siblings. What a source takes differs from its target by at most half of its last residual document.

Everything is DataFrame functions; a level of the tree is one shuffle, and the levels shrink by the fan-in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.storage import Workspace, broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
FAN_IN = 32
#: Sources that a broadcast table may hold; a row has about 100 bytes.
SOURCES_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, size): source, source_size, n_sized, target.

    The weights repeat over the sources in code point order, null last. The whole is ``share`` of all sizes. A target
    stops at ``most`` times its source's size, and the excess goes to the others by weight until none is above. That
    level is found from running sums over the sources in the order in which they fill up. One task handles the table of
    sources, which has a row for each distinct source and not for each document.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_sized"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("full_at", "place")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighted.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / rest).withColumn("turn", F.row_number().over(filling))
    first_open = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("turn", "level"))).over(everything)["level"]
    return levels.withColumn("open", first_open).select("source", "source_size", "n_sized", F.coalesce(F.least("cap", F.col("open") * F.col("weight")), "cap").alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


_ITEM = "struct<key:struct<size:bigint,id:bigint>,mass:double>"
_DECIDED = "array<struct<size:bigint,id:bigint,up:int>>"


def _decided(item: Column, up: int) -> Column:
    return F.array(F.struct(item["key"]["size"].alias("size"), item["key"]["id"].alias("id"), F.lit(up).alias("up")))


def _state(item: Column, mass: Column, out: Column) -> Column:
    return F.struct(F.struct(item["key"].alias("key"), mass.alias("mass")).alias("carry"), out.alias("out"))


def _meet(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """A step of the pass over a group: the carried item meets the next."""

    def step(state: Column, item: Column) -> Column:
        carry, out = state["carry"], state["out"]
        size, mass, other, other_mass = carry["key"]["size"], carry["mass"], item["key"]["size"], item["mass"]
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), carry["key"], item["key"], mass), F.lit(1 << 52)) / F.lit(float(1 << 52))

        def settle(t: Column) -> Column:
            up, gain, loss = t["chance"] * (t["gain"] + t["loss"]) < t["loss"], t["gain"], t["loss"]
            return (
                F.when(up & (gain >= size - mass), _state(item, other_mass - gain, F.concat(out, _decided(carry, 1))))
                .when(up, _state(carry, mass + gain, F.concat(out, _decided(item, 0))))
                .when(loss >= mass, _state(item, other_mass + loss, F.concat(out, _decided(carry, 0))))
                .otherwise(_state(carry, mass - loss, F.concat(out, _decided(item, 1))))
            )

        met = _let(F.struct(F.least(size - mass, other_mass).alias("gain"), F.least(mass, other - other_mass).alias("loss"), chance.alias("chance")), settle)
        return F.when(carry.isNull(), _state(item, other_mass, out)).otherwise(met)

    return step


def _round_groups(items: DataFrame, seed: int, level: int) -> DataFrame:
    """Items (source, node, key, mass), a bounded number to each node: source, node, carry, out."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.lit(None).cast(_DECIDED).alias("out"))
    start = F.struct(start["carry"].alias("carry"), F.array().cast(_DECIDED).alias("out"))
    groups = items.groupBy("source", "node").agg(F.array_sort(F.collect_list(F.struct("key", "mass"))).alias("items"))
    return groups.select("source", "node", F.aggregate("items", start, _meet(seed, level)).alias("r")).select("source", "node", "r.carry", "r.out")


def mix(sizes: DataFrame, work: Workspace, seed: int = 0, fan_in: int = FAN_IN, **rules) -> DataFrame:
    """How often each row of ``sizes`` (doc_id, source, size) is taken: those columns, source_size, target, copies, taken.

    Rows with equal columns are rounded each on its own. Documents without words are never taken. Sources without words
    have target 0. Null is a source of its own. An empty table gives an empty table. Repeated calls agree. How long a text
    is makes no difference, nor do other columns of ``sizes``, which are dropped.
    """
    targets = broadcast_if_small(work.table(source_targets(sizes, **rules), "targets"), SOURCES_BROADCAST)
    known = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(sizes["doc_id"], sizes["source"], "size", "source_size", "n_sized", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = known.withColumn("whole", F.floor(rate).cast("int")).withColumn("part", rate - F.floor(rate))
    open_ = (F.col("size") > 0) & (F.col("part") > 0)
    leaves = F.greatest(F.ceil(F.col("n_sized") / F.lit(fan_in)), F.lit(1))
    key = F.struct(F.col("size").alias("size"), F.col("doc_id").alias("id"))
    # Rows that share source, id and size would all meet in one leaf: where there are many, their place in the table deals them.
    crowds = work.table(sizes.groupBy("source", "doc_id", "size").count().where(F.col("count") > fan_in), "crowds")
    dealt = F.xxhash64("doc_id", "size")
    if not crowds.isEmpty():
        crowds = broadcast_if_small(crowds.withColumn("crowded", F.lit(True)), SOURCES_BROADCAST)
        same = known["source"].eqNullSafe(crowds["source"]) & known["doc_id"].eqNullSafe(crowds["doc_id"]) & (known["size"] == crowds["size"])
        known = known.withColumn("place", F.monotonically_increasing_id()).join(crowds, same, "left").select(*[known[x] for x in known.columns], "place", "crowded")
        dealt = F.when(F.col("crowded"), F.xxhash64("place")).otherwise(dealt)
    items = known.where(open_).select("source", F.pmod(dealt, leaves).alias("node"), key.alias("key"), (F.col("part") * F.col("size")).alias("mass"))
    largest = targets.agg(F.max("n_sized")).first()[0] or 0
    nodes, level, decided = max(1, -(-largest // fan_in)), 0, []
    while True:
        done = work.table(_round_groups(items, seed, level), f"level{level}")
        decided.append(done.select("source", F.explode("out").alias("d")).select("source", "d.id", "d.size", "d.up"))
        if nodes == 1:
            break
        items = done.where(F.col("carry").isNotNull()).select("source", F.floor(F.col("node") / fan_in).alias("node"), "carry.key", "carry.mass")
        nodes, level = -(-nodes // fan_in), level + 1
    last = done.select("source", "carry.key.id", "carry.key.size", (F.col("carry.mass") * 2 >= F.col("carry.key.size")).cast("int").alias("up"))
    decided.append(last.where(F.col("size").isNotNull()))
    ups = decided[0]
    for more in decided[1:]:
        ups = ups.unionByName(more)
    closed = known.where(~open_).select("source", F.col("doc_id").alias("id"), "size", F.lit(0).alias("up"))
    rows = ups.unionByName(closed)
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(F.col("id").alias("doc_id"), rows["source"], "size", "source_size", "target", "up")
    copies = F.when(F.col("size") > 0, F.floor(rate).cast("int") + F.col("up")).otherwise(0)
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("up")


def document_sizes(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, source and size of the texts; written, for counting words is the only pass over them."""
    return work.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
