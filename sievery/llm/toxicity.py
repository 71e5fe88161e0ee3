"""Toxicity by multiple-instance learning: sentences are scored, but only documents are labelled.

A sentence is toxic with the probability that a logistic model gives for its words and the beginnings of its words, and a
document is toxic unless all its sentences are not (noisy-or), a sentence of no words that every document has among them.
So the labels of documents train the sentence model, and its scores say which sentences of a document are to blame.

Which features count is told by a likelihood ratio over a bounded sample of labelled documents. Each step of the fit is
one pass over the sample's sentences: tasks add up loss and gradient of what they read, and the driver sees one vector for
each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from sievery.llm.words import _LOWER, PLAIN, Block, _byte_class, _weights_of, blocks, mix, small_batches
from sievery.storage import Workspace

#: Labelled documents that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Features of the model, at most, and the least number of documents and likelihood ratio (a chance of one in 1,000) that make one.
FEATURES, DOCUMENTS, RATIO = 1 << 14, 3, 10.83
#: Bytes of a word's beginnings that are features besides the word.
PREFIXES = range(3, 9)
STEPS, RATE, DECAY = 40, 0.3, 1e-3
#: A sentence with this probability or more is to blame.
BLAMED = 0.5
#: A document with this score or more is predicted toxic.
TOXIC = 0.7

_IS_END = ~_byte_class([(b, b) for b in b".!?\n\r"])
_MASK = np.uint64((1 << 20) - 1)


@dataclass
class Model:
    """Hashes of features, ascending, and their weights; the weights of a sentence and of a document as such."""

    features: np.ndarray
    weights: np.ndarray
    sentence: float
    document: float


class Sentences:
    """The sentences of a block of texts: the first of their words, and their texts."""

    def __init__(self, block: Block):
        self.block, n = block, len(block.hashes)
        text = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))
        part = np.searchsorted(np.flatnonzero(_IS_END[block.data]), block.start) + text * (len(block.data) + 1)
        opens = np.ones(n, bool)
        opens[1:] = part[1:] != part[:-1]
        self.first, self.of_word = np.flatnonzero(opens), np.cumsum(opens) - 1
        self.text = text[self.first]

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of features and the words they come from: of words, then of beginnings of longer words."""
        block = self.block
        yield block.hashes, np.arange(len(block.hashes))
        value, at = np.zeros(len(block.hashes), np.uint64), np.arange(len(block.hashes))
        for k in range(max(PREFIXES)):
            at = at[block.length[at] > k]
            value[at] += (_LOWER[block.data[block.start[at] + k]].astype(np.uint64) + np.uint64(1)) * _weights_of(k + 1)[k]
            if k + 1 in PREFIXES:
                longer = at[block.length[at] > k + 1]
                yield mix(value[longer] ^ np.uint64((k + 1) << 56)), longer


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Finder:
    """Places of hashes among the features of a model."""

    def __init__(self, features: np.ndarray):
        self.features, self.table = features, np.zeros(1 << 20, bool)
        self.table[(features & _MASK).astype(np.int64)] = True

    def found(self, sentences: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a sentence and a feature's place, in order."""
        pairs, n = [], max(len(self.features), 1)
        for hashes, word in sentences.features():
            at = np.flatnonzero(self.table[(hashes & _MASK).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
            at, place = (x[self.features[place] == hashes[at]] for x in (at, place)) if len(at) else (at, at)
            pairs.append(sentences.of_word[word[at]] * n + place)
        return np.divmod(np.unique(np.concatenate(pairs)), n)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts with each label a feature is."""
    held: list[np.ndarray] = []
    labels: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        codes, label = np.concatenate([*held, np.zeros(0, np.uint64)]), np.concatenate([*labels, np.zeros(0, np.int64)])
        held.clear(), labels.clear()
        order = np.argsort(codes, kind="stable")
        codes, first = np.unique(codes[order], return_index=True)
        toxic = np.add.reduceat(label[order], first) if len(codes) else label
        return pa.RecordBatch.from_pydict({"feature": pa.array(codes.view(np.int64)), "toxic": pa.array(toxic), "n": pa.array(np.diff(np.append(first, len(order))))})

    for batch in batches:
        for block in blocks(batch.column(1), PLAIN):
            found = list(Sentences(block).features())
            for i in range(*block.rows):
                low, high = block.first[i - block.rows[0]], block.first[i - block.rows[0] + 1]
                own = np.unique(np.concatenate([h[np.searchsorted(w, low) : np.searchsorted(w, high)] for h, w in found]))
                held.append(own)
                labels.append(np.full(len(own), batch.column(0)[i].as_py(), np.int64))
            if sum(map(len, held)) > 1 << 21:
                yield flush()
    yield flush()


def _instances(shared):
    """Of each text the label and its sentences: how often each distinct set of features occurs, its size, and the sets one after the other."""

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            for block in blocks(batch.column(1), PLAIN):
                sentences = Sentences(block)
                of, place = finder.found(sentences)
                rows = []
                for i in range(len(block.first) - 1):
                    own = np.searchsorted(sentences.text, [i, i + 1])
                    at = np.searchsorted(of, np.arange(own[0], own[1] + 1))
                    sets: dict[bytes, int] = {}
                    for a, b in zip(at[:-1], at[1:], strict=True):
                        key = place[a:b].astype(np.int32).tobytes()
                        sets[key] = sets.get(key, 0) + 1
                    rows.append((list(sets.values()), [len(k) // 4 for k in sets], b"".join(sets)))
                label = batch.column(0).slice(block.rows[0], len(rows))
                counts, sizes, places = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([label, pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), pa.array(places, pa.binary())], ["label", "counts", "sizes", "places"])

    return instances


def gradient(weights: np.ndarray, label: np.ndarray, document: np.ndarray, count: np.ndarray, of: np.ndarray, place: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient of documents with labels: ``document`` and ``count`` of each instance, ``place`` of a feature and ``of`` which instance.

    The last weights are those of a sentence and of a document as such.
    """
    z = weights[-2] + np.bincount(of, weights[place], len(count))
    rest = _softplus(weights[-1]) + np.bincount(document, count * _softplus(z), len(label))
    missing = -np.expm1(-rest)
    loss = np.where(label == 1, -np.log(np.maximum(missing, 1e-300)), rest).sum()
    of_rest = np.where(label == 1, -np.exp(-rest) / np.maximum(missing, 1e-300), 1.0)
    of_z = of_rest[document] * count / (1 + np.exp(-z))
    found = np.bincount(place, of_z[of], len(weights))
    found[-2], found[-1] = of_z.sum(), of_rest.sum() / (1 + np.exp(-weights[-1]))
    return float(loss), found


def _gradients(shared):
    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, loss, total, n = shared.value, 0.0, np.zeros(len(shared.value)), 0
        for batch in batches:
            counts, sizes = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            document = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            place = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32)
            more, found = gradient(weights, batch.column(0).to_numpy(), document, counts, np.repeat(np.arange(len(sizes)), sizes), place)
            loss, total, n = loss + more, total + found, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"loss": [loss], "n": pa.array([n], pa.int64()), "gradient": [total.tobytes()]})

    return gradients


def _sampled(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int) -> DataFrame:
    """label and text of ``sample`` labelled documents at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic").cast("int") > 0).cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = rows.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = work.table(chosen, "chosen")
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return work.table(texts.select("label", "text"), "sample")


def learn(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int = SAMPLE, features: int = FEATURES, steps: int = STEPS) -> Model:
    """A model from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) knows, at most ``sample`` of them.

    A document with several labels is toxic if one says so, and of rows that repeat an id the one with the smallest text counts. Null ids and
    null labels are no labels. Without labelled documents the model gives every text the score 0.5.
    """
    spark = docs.sparkSession
    rows = _sampled(docs, labels, work, sample)
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf, 0.0)
    with small_batches(spark):
        counts = rows.mapInArrow(_counted, "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("n").alias("b")).where(F.col("b") >= DOCUMENTS)
        # Twice the log likelihood that presence and label depend on each other.
        part = lambda seen, of, total: F.when(seen > 0, seen * F.log(seen * n / (of * total))).otherwise(0.0)
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        ratio = 2 * (part(a, b, toxic) + part(b - a, b, n - toxic) + part(toxic - a, n - b, toxic) + part((n - toxic) - (b - a), n - b, n - toxic))
        best = counts.withColumn("ratio", ratio).where(F.col("ratio") > RATIO).orderBy(F.desc("ratio"), "feature").limit(features).toArrow()
        order = np.argsort(best["feature"].to_numpy().view(np.uint64))
        found = best["feature"].to_numpy().view(np.uint64)[order]
        shared = spark.sparkContext.broadcast(found)
        instances = work.table(rows.mapInArrow(_instances(shared), "label int, counts array<int>, sizes array<int>, places binary"), "instances")
    # Bayes' weights to start with, a part of each, for features of a word overlap.
    a, b = best["a"].to_numpy()[order], best["b"].to_numpy()[order]
    start = np.log((a + 0.5) / (toxic + 1)) - np.log((b - a + 0.5) / (n - toxic + 1))
    weights = np.concatenate([start / len(PREFIXES), [-6.0, -4.0]])
    return Model(found, *_fitted(instances, weights, steps))


def _fitted(instances: DataFrame, weights: np.ndarray, steps: int) -> tuple[np.ndarray, float, float]:
    """Weights after ``steps`` of a gradient descent with moments (Adam)."""
    context = instances.sparkSession.sparkContext
    first, second = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(1, steps + 1):
        shared = context.broadcast(weights)
        parts = instances.mapInArrow(_gradients(shared), "loss double, n long, gradient binary").collect()
        shared.unpersist()
        n = sum(p["n"] for p in parts)
        slope = np.sum([np.frombuffer(p["gradient"]) for p in parts], axis=0) / n + DECAY / n * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights[:-2], float(weights[-2]), float(weights[-1])


def scored(column: pa.Array, model: Model, finder: Finder) -> Iterator[tuple[np.ndarray, list[list[dict]]]]:
    """Scores of the texts of a column and the sentences to blame, a block at a time."""
    for block in blocks(column, PLAIN):
        sentences = Sentences(block)
        of, place = finder.found(sentences)
        z = model.sentence + np.bincount(of, model.weights[place], len(sentences.first))
        n = len(block.first) - 1
        rest = _softplus(model.document) + np.bincount(sentences.text, _softplus(z), n)
        blamed: list[list[dict]] = [[] for _ in range(n)]
        chance = 1 / (1 + np.exp(-z))
        at = np.flatnonzero(chance >= BLAMED)
        if len(at):
            # Places in bytes become places in code points.
            before = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            last = np.append(sentences.first, len(block.hashes))[at + 1] - 1
            begin = before[block.begin[sentences.text[at]]]
            starts, ends = before[block.start[sentences.first[at]]] - begin, before[block.start[last] + block.length[last]] - begin
            for text, start, end, p in zip(sentences.text[at].tolist(), starts.tolist(), ends.tolist(), chance[at].tolist(), strict=True):
                blamed[text].append({"start": start, "end": end, "score": p})
        yield -np.expm1(-rest), blamed


_BLAME = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
_BLAME_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any other columns) with ``score``, the chance that the text is toxic, and ``blamed``, its sentences to blame.

    A sentence has start and end, in code points, and its own score, ``BLAMED`` or more. Sentences end at a full stop, an exclamation or
    question mark or the end of a line; words are runs of letters, digits and characters outside ASCII. A null text counts as an empty one; both
    have the score of a document as such, and no sentences. Columns of ``docs`` named score or blamed are replaced, others are kept, whatever
    their names. Each row is scored by its text alone, so repeated rows and ids get equal scores. Texts of any length are read whole. An
    empty table stays empty.
    """
    docs = docs.drop("score", "blamed").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value.features)
        for batch in batches:
            scores, blamed = [], []
            for some, sentences in scored(batch.column(batch.schema.get_field_index("text")), shared.value, finder):
                scores.append(some)
                blamed.extend(sentences)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*scores, np.zeros(0)])), pa.array(blamed, _BLAME_ARROW)], [*batch.schema.names, "score", "blamed"])

    return docs.mapInArrow(tell, StructType([*docs.schema, StructField("score", DoubleType()), StructField("blamed", ArrayType(_BLAME))]))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: a third, by the CRC of the id; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
