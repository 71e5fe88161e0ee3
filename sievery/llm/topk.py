"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments, of which it keeps means and deviations: one segment, then four, then sixteen. For a
query and a candidate these bound the squared distance from below, and so the inner product from above: by the
Cauchy-Schwarz inequality a segment of length l adds at most l * mean * mean' + sqrt(l) dev * sqrt(l) dev'. Coarse
bounds come first; only pairs that reach the query's fifth best score so far go on to the next finer ones, and the
survivors are computed exactly. Some queries try the bounds on each block of candidates; where they let most pairs
through, the others compute that block exactly at once, which is cheaper than to bound it first.

Queries and candidates are packed into blocks of bounded size and dealt over a grid: a task gets the queries of a column
and the candidates of a row, so that each query meets each candidate once. A column holds a bounded number of queries,
and tasks are a few for each core, so that copies grow no faster than the tables as long as one column holds all queries.
A task reads its queries first, then candidates block by block, and keeps the best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 256
K = 5
SEGMENTS = (1, 4, 16)
QUERIES = 1024
CANDIDATES = 2048
#: Bytes of query vectors that a task holds, at four a component.
COLUMN = 64 << 20
#: Tasks of the grid for each core.
TASKS = 4
#: Queries that meet a block of candidates at a time, and candidates that they meet before they have found any.
ROWS, FIRST = 512, 64
#: Queries that try the bounds on a block, and the share of pairs at most that bounds may leave to be used.
TRIED, LEFT = 64, 1 / 8
#: Share of pairs below which survivors are computed one by one.
FEW = 1 / 64
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1
_BLOCK = "dim int, at long, first long, small boolean, ids binary, vectors binary"


def usable(embedding: Column) -> Column:
    """Vectors without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & finite


def _pack(size: int):
    """Blocks of vectors of one length, by id, as whole numbers of two bytes where these do; ``at`` numbers them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = TaskContext.get().partitionId()

        def full(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            while len(ids) >= least:
                order = np.argsort(ids[:size], kind="stable")
                names, block = ids[order], vectors[order]
                small = bool(np.abs(block).max(initial=0) < 2**15)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "at": pa.array([made]), "first": pa.array(names[:1]), "small": pa.array([small]), "ids": pa.array([names.tobytes()]), "vectors": pa.array([block.astype(np.int16 if small else np.float64).tobytes()])})
                made += 1
                ids, vectors = ids[size:], vectors[size:]
            if len(ids):
                held[dim] = [(ids, vectors)]

        for batch in batches:
            lists, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            values = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            length = np.diff(offsets)
            for dim in np.unique(length).tolist():
                rows = np.flatnonzero(length == dim)
                vectors = values[offsets[rows][:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[rows], vectors))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    yield from full(dim, size)
        for dim in list(held):
            yield from full(dim, 1)

    return pack


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Weighted means and deviations of the segments; products of two vectors' features bound their inner product."""
    cuts = np.unique(np.linspace(0, vectors.shape[1], segments + 1).astype(int))[:-1] if vectors.shape[1] else np.zeros(0, int)
    if not len(cuts):
        return np.zeros((len(vectors), 0))
    length = np.diff(np.append(cuts, vectors.shape[1]))
    total = np.add.reduceat(vectors, cuts, axis=1)
    spread = np.add.reduceat((vectors - np.repeat(total / length, length, axis=1)) ** 2, cuts, axis=1)
    return np.concatenate([total / np.sqrt(length), np.sqrt(spread)], axis=1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of vectors of whole numbers, as int64; beyond its range the nearest number in it."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    found = whole(a).dot(whole(b).T)
    return np.array([[min(max(int(v), -(2**63)), 2**63 - 1) for v in row] for row in found], dtype=np.int64).reshape(len(a), len(b))


class Best:
    """The best ``k`` of the candidates that some queries have met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.k, self.norm = ids, k, _norm(queries)
        self.queries = queries.astype(np.float32) if self.norm < 2**24 else queries
        self.scores, self.names = np.full((len(ids), k), _LOWEST, np.int64), np.full((len(ids), k), _HIGHEST, np.int64)
        self.held, self.bar = np.zeros(len(ids), np.int64), np.full(len(ids), _LOWEST, np.float32)
        self.tried = np.unique(np.linspace(0, len(ids) - 1, TRIED).astype(int))
        self.features = {s: segment_features(self.queries[self.tried].astype(np.float64), s) for s in SEGMENTS}
        self.seen, self.last = 0, _LOWEST

    def meet(self, names: np.ndarray, vectors: np.ndarray) -> None:
        """Take a block of candidates, by id."""
        low = 0
        while low < len(names):
            high = min(len(names), low + max(FIRST, self.seen))
            self._meet(names[low:high], vectors[low:high])
            self.seen, self.last = self.seen + high - low, max(self.last, int(names[high - 1]))
            low = high

    def _reaching(self, own: np.ndarray, features: np.ndarray, least: np.ndarray) -> np.ndarray:
        bound = own @ features.T
        bound += np.abs(bound) * 1e-9 + 1e-6
        return bound >= least[:, None].astype(np.float64)

    def _levels(self, vectors: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Resolutions, coarse ones first, that leave few pairs of the queries that try them; none if all leave many."""
        least, alive, share, used = self.scores[self.tried, -1], True, 1.0, []
        for s in SEGMENTS:
            features = segment_features(vectors, s)
            alive = self._reaching(self.features[s], features, least) & alive
            if alive.mean() <= share / 2:
                share = alive.mean()
                used.append((s, features))
        return used if share <= LEFT else []

    def _meet(self, names: np.ndarray, vectors: np.ndarray) -> None:
        # Candidates with larger ids than all before lose every tie.
        later = bool(self.held.min() >= self.k) and int(names[0]) > self.last
        single = max(1.0, self.norm) * max(1.0, _norm(vectors)) < 2**24
        levels = self._levels(vectors)
        some = vectors.astype(np.float32) if single else vectors
        for low in range(0, len(self.ids), ROWS):
            part = slice(low, low + ROWS)
            queries, least, rows, columns, alive = self.queries[part], self.scores[part, -1], None, None, None
            for s, features in levels:
                reached = self._reaching(segment_features(queries.astype(np.float64), s), features, least)
                alive = reached if alive is None else alive & reached
            if alive is not None:
                pairs = np.nonzero(alive)
                if single and len(pairs[0]) < FEW * alive.size:
                    self._add(low + pairs[0], names[pairs[1]], np.einsum("ij,ij->i", queries[pairs[0]], some[pairs[1]]).astype(np.int64), later)
                    continue
                rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                if not len(rows):
                    continue
            rows = np.arange(len(queries)) if rows is None else rows
            found = names if columns is None else names[columns]
            of, by = queries if alive is None else queries[rows], some if columns is None else some[columns]
            score = of @ by.T if single else inner_products(of.astype(np.float64), by.astype(np.float64))
            bar = (self.bar[part] if single else least)[rows]
            most = score.max(axis=1)
            at = np.flatnonzero(most > bar if later else most >= bar)
            if len(at):
                score, bar = score[at], bar[at][:, None]
                row, column = np.divmod(np.flatnonzero(score > bar if later else score >= bar), score.shape[1])
                self._add(low + rows[at[row]], found[column], score[row, column].astype(np.int64), later)

    def _add(self, row: np.ndarray, name: np.ndarray, score: np.ndarray, later: bool) -> None:
        least = self.scores[row, -1]
        better = (score > least) & (self.ids[row] != name) if later else ((score > least) | (score == least) & ((name < self.names[row, -1]) | (self.held[row] < self.k))) & (self.ids[row] != name)
        row, name, score = row[better], name[better], score[better]
        if not len(row):
            return
        changed, new = np.unique(row, return_counts=True)
        self.held[changed] = np.minimum(self.held[changed] + new, self.k)
        row = np.concatenate([row, np.repeat(changed, self.k)])
        name, score = np.concatenate([name, self.names[changed].ravel()]), np.concatenate([score, self.scores[changed].ravel()])
        order = np.lexsort((name, ~score, row))
        row, name, score = row[order], name[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.scores[row[keep], place[keep]], self.names[row[keep], place[keep]] = score[keep], name[keep]
        self.bar[changed] = self.scores[changed, -1]

    def found(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.names[row, place]), pa.array(self.scores[row, place])], ["query_id", "vec_id", "score"])


def _norm(vectors: np.ndarray) -> float:
    """Length of the longest vector; products of two, and all sums on the way, are no larger than the product of their lengths."""
    return float(np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1).max(initial=0)))


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if now != (r["task"], r["dim"]):
                    if best is not None:
                        yield best.found()
                    now, asked, best = (r["task"], r["dim"]), [], None
                ids = np.frombuffer(r["ids"], np.int64)
                vectors = np.frombuffer(r["vectors"], np.int16 if r["small"] else np.float64).reshape(len(ids), r["dim"])
                if not r["candidates"]:
                    asked.append((ids, vectors))
                elif asked or best is not None:
                    if best is None:
                        best, asked = Best(*(np.concatenate(x) for x in zip(*asked, strict=True)), k), []
                    best.meet(ids, vectors.astype(np.float64))
        if best is not None:
            yield best.found()

    return search


def dealt(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Blocks of queries and candidates (vec_id, embedding) on a grid: those of each task, queries first, then candidates by id."""
    components = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0
    columns = 1 + 4 * components // COLUMN
    tasks = TASKS * vectors.sparkSession.sparkContext.defaultParallelism
    rows = max(1, tasks // columns)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = vectors.mapInArrow(_pack(CANDIDATES), _BLOCK).select("*", F.lit(True).alias("candidates"), (F.col("at") % rows).alias("row"), every(columns).alias("column"))
    right = asked.mapInArrow(_pack(QUERIES), _BLOCK).select("*", F.lit(False).alias("candidates"), every(rows).alias("row"), (F.col("at") % columns).alias("column"))
    blocks = left.unionByName(right).withColumn("task", (F.col("row") * columns + F.col("column")).cast("int")).drop("at", "row", "column")
    return blocks.repartitionById(rows * columns, F.col("task")).sortWithinPartitions("task", "dim", "candidates", "first")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the highest inner product for each row of ``queries``: query_id, rank, vec_id, score.

    Components x count as floor(256 * x). All candidates but those with the query's own id are compared, ties go to the
    smaller id, and a query with fewer candidates gets all. Vectors that are null or hold null or non-finite components,
    and rows without id, take no part; vectors of different lengths are not compared. Rows that repeat an id are
    candidates each for itself; of queries that repeat an id, the smallest vector counts. An empty table gives none.
    """
    columns = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    all_rows = vectors.select(*columns).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = queries.select(*columns).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).sortWithinPartitions("vec_id")
    best = dealt(asked, all_rows).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
