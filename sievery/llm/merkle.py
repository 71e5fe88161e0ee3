"""A Merkle tree over a dataset, with a proof for each row.

The rows of a language are the leaves of its tree, in order; the roots of the languages are the leaves of the tree above.
A parent has two children, the last of a level perhaps one, so the sizes of the trees give the arity of every parent.

Nodes are keyed by the run of ``2 ** BITS`` places that they lie in. A task combines what it gets of a run as the digests
arrive, in any order: a partial parent holds indexed digests of its children, becomes a digest when it has as many as its
arity, and is passed on to its own parent at once. What remains of a run is one node, and those nodes, the frontier, are
reshuffled by the runs of the next round, until a tree is one node. Then the links are followed back: each round gives
the nodes of a run the steps of their proof within it, followed by those of the run's own node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.storage import Workspace, broadcast_if_small

#: Places of a run, as a power of two: what a task combines at a time (about 200 bytes for each).
BITS = 12
#: Rows of counts of parts of the table, or of frontiers, that may be broadcast (about 40 bytes each, frontiers' proofs some thousand).
BROADCAST = 100_000
STEP = "struct<left: boolean, digest: string>"
_STEP = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))


def digest(*values: Column) -> Column:
    """SHA-256, in lower-case hex, of values one after the other: ``-`` for null, else the number of UTF-8 bytes, ``:``, and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def hashed(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def combine(arriving: Iterable[tuple[int, str]], size: int, levels: int) -> dict[tuple[int, int], str]:
    """All nodes, by level and place, over ``arriving`` nodes (place, digest) of a level with ``size`` nodes, for up to ``levels`` levels above it."""
    nodes: dict[tuple[int, int], str] = {}
    partial: dict[tuple[int, int], dict[int, str]] = {}
    sizes = [size]
    while len(sizes) <= levels and sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    for place, value in arriving:
        level = 0
        while True:
            nodes[level, place] = value
            if level + 1 >= len(sizes):
                break
            parent = place // 2
            held = partial.setdefault((level + 1, parent), {})
            held[place] = value
            if len(held) < min(2, sizes[level] - 2 * parent):
                break
            del partial[level + 1, parent]
            level, place, value = level + 1, parent, hashed(v for _, v in sorted(held.items()))
    return nodes


def _heights(size: int, levels: int) -> int:
    return min(levels, max(size - 1, 0).bit_length())


def indexed(df: DataFrame, work: Workspace, tree: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``place``, 0, 1, 2 ... in each ``tree`` by ``order``, and ``size``, the rows of the tree; no task gets all rows of a tree.

    Rows are dealt by ranges of tree and order, and rows that are alike there by a number of their own; counts of the parts give the offsets.
    """
    numbered = work.table(df.withColumn("_number", F.monotonically_increasing_id()), f"{name}-numbered")
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_number")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Within a part monotonically_increasing_id goes on by one for each row, in the order of the sort.
    dealt = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = work.table(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop("_number"), f"{name}-dealt")
    counts = work.table(dealt.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), f"{name}-counts")
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_in"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(Window.partitionBy(tree)).alias("size"))
    met = dealt.join(broadcast_if_small(offsets, BROADCAST), dealt[tree].eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_in")))
    return met.withColumn("place", F.col("_at") + F.col("_offset")).drop("_tree", "_in", "_offset", "_part", "_at")


def _raise(levels: int):
    def up(nodes: pa.Table) -> pa.Table:
        places, size = nodes["place"].to_pylist(), nodes["size"][0].as_py()
        height = _heights(size, levels)
        top = combine(zip(places, nodes["digest"].to_pylist(), strict=True), size, levels)[height, places[0] >> height]
        return pa.table({"tree": nodes["tree"].combine_chunks()[:1], "place": pa.array([places[0] >> levels], pa.int64()), "size": pa.array([-(-size // (1 << levels))], pa.int64()), "digest": [top]})

    return up


def climb(nodes: DataFrame, work: Workspace, name: str, bits: int = BITS) -> list[DataFrame]:
    """``nodes`` (tree, place, size, digest) and the frontier of each round, of which the last has the root of each tree."""
    rounds, n = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while n > 1 or len(rounds) == 1:
        given = rounds[-1].select("tree", "place", "size", "digest", F.shiftright("place", bits).alias("run"))
        up = given.groupBy("tree", "run").applyInArrow(_raise(bits), "tree string, place long, size long, digest string")
        rounds.append(work.table(up, f"{name}-frontier"))
        n = -(-n // (1 << bits))
    return rounds


def _lower(levels: int, columns: list[str]):
    def down(nodes: pa.Table, above: pa.Table) -> pa.Table:
        places, size, root, rest = nodes["place"].to_pylist(), nodes["size"][0].as_py(), above["root"][0].as_py(), above["proof"][0].as_py()
        found, height, proofs = combine(zip(places, nodes["digest"].to_pylist(), strict=True), size, levels), _heights(size, levels), []
        for place in places:
            steps = [{"left": bool(place >> level & 1), "digest": found.get((level, place >> level ^ 1))} for level in range(height)]
            proofs.append(steps + rest)
        return nodes.select(columns).append_column("root", pa.array([root] * len(places))).append_column("proof", pa.array(proofs, _STEP))

    return down


def descend(rounds: list[DataFrame], above: DataFrame, work: Workspace, name: str, bits: int = BITS) -> DataFrame:
    """The nodes of ``rounds[0]`` with ``root`` and ``proof``, given those of their tree's root (``above``: tree, root, proof).

    A proof is a list of steps: a sibling's digest, null where a parent has one child, and whether the sibling stands left.
    """
    known = above.select("tree", F.lit(0).cast("long").alias("run"), "root", "proof")
    for i in reversed(range(len(rounds) - 1)):
        nodes = rounds[i]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields] + ["root string", f"proof array<{STEP}>"])
        runs = nodes.withColumn("run", F.shiftright("place", bits)).groupBy("tree", "run").cogroup(known.groupBy("tree", "run"))
        known = runs.applyInArrow(_lower(bits, nodes.columns), schema)
        if i:
            known = work.table(known.select("tree", F.col("place").alias("run"), "root", "proof"), f"{name}-proofs")
    return known


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(proof, leaf, lambda value, step: F.sha2(F.when(step["digest"].isNull(), value).when(step["left"], F.concat(step["digest"], value)).otherwise(F.concat(value, step["digest"])), 256))


def leaves(docs: DataFrame, added: Column | None = None) -> Column:
    """The leaf of a row of ``docs``; ``added`` goes to n_chars."""
    n_chars = F.col("n_chars") if added is None else F.col("n_chars").cast("decimal(20,0)") + added
    return digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))


def manifest(docs: DataFrame, work: Workspace, tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """doc_id, lang, leaf, subroot (of the language), root and proof (steps from leaf to root) of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    With ``tampered``, a column that says which rows to tamper with, there is also ``tampered_leaf``: the leaf with n_chars one higher, else null.
    Leaves stand by doc_id, null first, and rows that repeat an id by their leaves; a null lang is a language of its own, before the others.
    Null and empty values differ. A row that is repeated is a leaf each time. Texts of any length are hashed whole by the JVM. An empty table has no
    rows and no root. Other columns are dropped.
    """
    changed = F.lit(None).cast("string") if tampered is None else F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), leaves(docs, F.lit(1)))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), leaves(docs).alias("digest"), changed.alias("tampered_leaf"))
    placed = climb(work.table(indexed(thin, work, "tree", ["doc_id", "digest"], "leaves"), "leaves"), work, "leaves", bits)
    # The languages are leaves themselves, of one tree.
    langs = indexed(placed[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("lang"), "digest"), work, "tree", ["lang"], "langs")
    upper = climb(work.table(langs, "langs"), work, "langs", bits)
    ends = upper[-1].select("tree", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof"))
    proved = descend(upper, ends, work, "langs", bits)
    roots = work.table(proved.select(F.col("lang").alias("tree"), F.col("digest").alias("subroot"), "root", "proof"), "subroots")
    found = descend(placed, roots, work, "leaves", bits).join(broadcast_if_small(roots.select(F.col("tree").alias("_tree"), "subroot"), BROADCAST), F.col("tree").eqNullSafe(F.col("_tree")))
    given = ["doc_id", F.col("tree").alias("lang"), F.col("digest").alias("leaf"), "subroot", "root", "proof"]
    return found.select(*given, *[] if tampered is None else ["tampered_leaf"])


def verified(docs: DataFrame, work: Workspace, tampered: Column) -> DataFrame:
    """``manifest`` with ``folded_root``, the root that follows from the tampered leaf, or else the leaf, and the proof, and whether it is the root."""
    folded = manifest(docs, work, tampered).withColumn("folded_root", fold(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def siblings(proof: Column) -> Column:
    """The digests of a proof's siblings, from the leaf up, one after the other."""
    return F.array_join(F.filter(F.transform(proof, lambda s: s["digest"]), lambda d: d.isNotNull()), "")


#: The whole query: CRC-32 by its definition over decimal ids, the tree level by level, and proofs folded level by level.
SQL = """
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, *,
        CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 7 END AS crc7
    FROM documents
), coded AS (
    SELECT r, doc_id, lang, n_chars, crc7,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
        coalesce(strlen(text) || ':' || text, '-') AS after
    FROM docs
), hashes AS (
    SELECT r, doc_id, lang, sha256(before || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || after) AS leaf,
        CASE WHEN crc7 = 0 AND n_chars IS NOT NULL THEN sha256(before || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR) || after) END AS changed
    FROM coded
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashes
), lower_tree(level, lang, i, n, h) AS (
    SELECT 0, lang, i, n, leaf FROM leaves
    UNION ALL
    SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lower_tree WHERE n > 1 GROUP BY level, lang, i // 2, n
), subroots AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), upper_tree(level, i, n, h) AS (
    SELECT 0, i, n, subroot FROM subroots
    UNION ALL
    SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE n > 1 GROUP BY level, i // 2, n
), lower_fold(r, level, i, n, h, proof) AS (
    SELECT r, 0, i, n, coalesce(changed, leaf), '' FROM leaves
    UNION ALL
    SELECT f.r, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '')
    FROM lower_fold f JOIN leaves l ON l.r = f.r LEFT JOIN lower_tree s ON s.level = f.level AND s.lang IS NOT DISTINCT FROM l.lang AND s.i = xor(f.i, 1)
    WHERE f.n > 1
), upper_fold(r, level, i, n, h, proof) AS (
    SELECT f.r, 0, s.i, s.n, f.h, f.proof FROM lower_fold f JOIN leaves l ON l.r = f.r JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang WHERE f.n = 1
    UNION ALL
    SELECT f.r, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '')
    FROM upper_fold f LEFT JOIN upper_tree s ON s.level = f.level AND s.i = xor(f.i, 1)
    WHERE f.n > 1
)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN upper_fold f ON f.r = l.r AND f.n = 1 JOIN upper_tree t ON t.n = 1
"""
