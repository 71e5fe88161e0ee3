"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts, learned from all training texts: for each context of up to three bytes, how often
each symbol followed. A symbol is predicted in its longest known context; where it never followed there, an escape is
paid (method C: as likely as the number of distinct symbols that did follow) and the next shorter context is asked, in
which the symbols of the longer one are excluded, for they would not have needed the escape. Last comes a uniform
distribution over all symbols not excluded. A text's score is the sum over its bytes and a closing symbol.

All nodes that any text asks for get their probability in a table, dealt by the two bytes before the symbol: one part has
all that the orders three and two of its nodes need, and the orders one and zero have few nodes whatever the corpus. The
most frequent nodes, of which the number is bounded, are looked up in a broadcast table; the others meet their
probabilities in a shuffle, as words do. Which nodes go which way changes no score.

Beside it a word model gives each text the score of its words. Counts of words are exact: frequent words, of which the
number is bounded, are looked up in a broadcast table, and the others meet their counts in a shuffle by hash, so that
no word's rows go to one task. What they add returns to the texts in blocks. A sample of the texts decides which words
take which way, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.llm.words import SPACED, blocks
from sievery.storage import Workspace

#: Bytes of a context; a node is a context and a symbol, packed in four bytes.
ORDER = 3
#: Nodes that are looked up in a broadcast table: the most frequent. The others meet their scores in a shuffle.
NODES = 1 << 20
#: Nodes for each part in which nodes get their scores, about.
PART = 1 << 14
#: Bytes that no UTF-8 text holds, before its start and behind its end.
START, END = 0xFF, 0xFE
SYMBOLS = 257
#: Words that are looked up in a broadcast table, and one text of so many that is looked at to choose them.
HOT_WORDS = 1 << 15
SAMPLE = 32
#: Words of the training texts for each group in which rarer words meet their counts.
GROUP = 4_000_000
PIECE = 1 << 20
CLASSES = 64


def padded(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a block one after the other, each between three start bytes and an end byte, and where each starts."""
    n = len(begin) - 1
    out = np.full(len(data) + (ORDER + 1) * n, START, dtype=np.uint8)
    shift = ORDER + (ORDER + 1) * np.arange(n)
    out[np.arange(len(data)) + np.repeat(shift, np.diff(begin))] = data
    out[begin[1:] + shift] = END
    return out, np.append(begin[:-1] + shift - ORDER, len(out))


def nodes(stream: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Context and symbol at each place of a padded stream, as a number, in pieces; the place of each piece's first."""
    for low in range(ORDER, len(stream), PIECE):
        s = stream[low - ORDER : low + PIECE].astype(np.uint32)
        yield low, s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]


def _count(hot):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hot.value
        word_counts, total, texts = np.zeros(len(words), np.int64), 0, 0
        #: Nodes, how often training texts have each, and how often all texts.
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, *[np.bincount(inverse, weights=np.concatenate([h[k] for h in held])).astype(np.int64) for k in (1, 2)]

        for batch in batches:
            train = pc.invert(batch.column(1))
            texts += pc.sum(train).as_py() or 0
            for trains, column in ((1, batch.column(0).filter(train)), (0, batch.column(0).filter(batch.column(1)))):
                for block in blocks(column, SPACED):
                    total += trains * len(block.hashes)
                    if len(words) and trains:
                        key, n = np.unique(block.hashes, return_counts=True)
                        at = np.minimum(np.searchsorted(words, key), len(words) - 1)
                        mine = words[at] == key
                        word_counts[at[mine]] += n[mine]
                    stream, _ = padded(block.data, block.begin)
                    for _, node in nodes(stream):
                        key, n = np.unique(node[(node & 0xFF) != START], return_counts=True)
                        held.append((key, trains * n, n))
                    if len(held) >= 16:
                        held = [merged()]
                        if len(held[0][0]) > 4 * NODES:
                            yield _pairs("n", *held.pop())
        if held:
            yield _pairs("n", *merged())
        if len(words):
            yield _pairs("w", words.view(np.int64), word_counts, word_counts)
        yield _pairs("t", np.array([0, 1]), np.array([total + texts, texts]), np.zeros(2))

    return count


def _pairs(kind: str, key: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(key)), *[pa.array(x.astype(np.int64)) for x in (key, n, m)]], ["kind", "key", "n", "m"])


@dataclass
class Model:
    """A trie, or the part of one below some pairs of bytes: nodes by context length, with what an escape from a longer context leaves of each."""

    node: list[np.ndarray]
    count: list[np.ndarray]
    context: list[np.ndarray]
    #: Of each context: total count and distinct symbols.
    total: list[np.ndarray]
    distinct: list[np.ndarray]
    #: Of each context, total and distinct symbols of the next shorter context without its own symbols.
    left_total: list[np.ndarray]
    left_distinct: list[np.ndarray]

    @staticmethod
    def from_counts(key: np.ndarray, n: np.ndarray, below: tuple[np.ndarray, np.ndarray]) -> Model:
        """Of the longest nodes with the same two bytes before the symbol, for some such pairs, and of all nodes of order one, sorted."""
        order = np.argsort(key)
        node, count = [key[order]], [n[order]]
        for length in range(ORDER - 1, -1, -1):
            if length == 1:
                node.insert(0, below[0])
                count.insert(0, below[1])
                continue
            shorter, inverse = np.unique(node[0] & (1 << 8 * (length + 1)) - 1, return_inverse=True)
            count.insert(0, np.bincount(inverse, weights=count[0], minlength=len(shorter)).astype(np.int64))
            node.insert(0, shorter)
        model = Model(node, count, [], [], [], [np.zeros(1)], [np.zeros(1)])
        for length in range(ORDER + 1):
            context, start = np.unique(node[length] >> 8, return_index=True)
            model.context.append(context)
            model.total.append(np.add.reduceat(count[length], start) if len(start) else np.zeros(0, np.int64))
            model.distinct.append(np.diff(np.append(start, len(node[length]))))
            if length:
                # The same symbols in the next shorter context, and the context itself.
                same = np.searchsorted(node[length - 1], node[length] & (1 << 8 * length) - 1)
                taken = np.add.reduceat(count[length - 1][same], start) if len(start) else np.zeros(0, np.int64)
                parent = np.searchsorted(model.context[length - 1], context & (1 << 8 * (length - 1)) - 1)
                model.left_total.append(model.total[length - 1][parent] - taken)
                model.left_distinct.append(model.distinct[length - 1][parent] - model.distinct[length])
        return model

    def scores(self, node: np.ndarray) -> np.ndarray:
        """Log10 probability of the symbol of each node (context of three bytes and symbol) in its context."""
        score = np.zeros(len(node))
        open_ = np.arange(len(node))
        total, distinct = None, None  # left of the context that is asked next, where a longer one was known
        for length in range(ORDER, -1, -1):
            if not len(open_):
                return score
            asked = node[open_] & (1 << 8 * (length + 1)) - 1
            at, known = _find(self.context[length], asked >> 8)
            own_total = np.where(known, self.total[length][at] if len(at) and len(self.context[length]) else 0, 0).astype(np.float64)
            own_distinct = np.where(known, self.distinct[length][at] if len(at) and len(self.context[length]) else 0, 0).astype(np.float64)
            if total is not None:
                own_total, own_distinct = np.where(np.isnan(total), own_total, total), np.where(np.isnan(distinct), own_distinct, distinct)
            whole = own_total + own_distinct
            place, found = _find(self.node[length], asked)
            hit = np.flatnonzero(found)
            score[open_[hit]] += np.log10(self.count[length][place[hit]] / whole[hit])
            miss = ~found
            pays = miss & (own_distinct > 0)
            score[open_[pays]] += np.log10(own_distinct[pays] / whole[pays])
            if length:
                nan = np.full(len(open_), np.nan)
                total = (np.where(known, self.left_total[length][at], nan) if len(self.context[length]) else nan)[miss]
                distinct = (np.where(known, self.left_distinct[length][at], nan) if len(self.context[length]) else nan)[miss]
            open_ = open_[miss]
        score[open_] -= np.log10(SYMBOLS - len(self.node[0]))
        return score


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def _chances(below):
    def chances(part: pa.Table) -> pa.Table:
        """Log10 probability of each node of a part."""
        key, n = part.column("key").to_numpy(), part.column("n").to_numpy()
        model = Model.from_counts(key[n > 0], n[n > 0], below.value)
        return pa.table({"key": part.column("key"), "m": part.column("m"), "chance": pa.array(model.scores(key))})

    return chances


class Scorer:
    """Frequent nodes, sorted, with their scores; those of frequent bytes in a table."""

    def __init__(self, key: np.ndarray, m: np.ndarray, chance: np.ndarray):
        self.key, self.chance = key, chance
        symbol, inverse = np.unique(key & 0xFF, return_inverse=True)
        weight = np.bincount(inverse, weights=m, minlength=len(symbol)) if len(symbol) else np.zeros(0)
        frequent = np.concatenate([symbol[np.argsort(-weight, kind="stable")][: CLASSES - 2].astype(np.int64), [START]])
        self.of_byte = np.zeros(256, dtype=np.uint32)
        self.of_byte[frequent] = np.arange(1, len(frequent) + 1)
        self.table = np.full(CLASSES ** (ORDER + 1), np.nan, dtype=np.float32)
        parts = [self.of_byte[key >> 8 * k & 0xFF] for k in range(ORDER, -1, -1)]
        plain = np.logical_and.reduce([p > 0 for p in parts])
        self.table[self._slot([p[plain] for p in parts])] = chance[plain]

    @staticmethod
    def _slot(parts: list[np.ndarray]) -> np.ndarray:
        a, b, c, d = parts
        return ((a * CLASSES + b) * CLASSES + c) * CLASSES + d

    def texts(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each text of a block without its rarer nodes; those, and the text of each."""
        stream, start = padded(data, begin)
        running = np.zeros(len(begin) - 1)
        rare, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, node in nodes(stream):
            c = self.of_byte[stream[low - ORDER : low + len(node)]]
            score = self.table[self._slot([c[:-3], c[1:-2], c[2:-1], c[3:]])].astype(np.float64)
            pad = stream[low : low + len(node)] == START
            score[pad] = 0
            rest = np.flatnonzero(np.isnan(score))
            at, known = _find(self.key, node[rest].astype(np.int64))
            score[rest] = np.where(known, self.chance[at], 0)
            rare.append(node[rest[~known]].astype(np.int64))
            owner.append(np.searchsorted(start, low + rest[~known], side="right") - 1)
            first = int(np.searchsorted(start, low, side="right")) - 1
            cuts = np.maximum(start[first : int(np.searchsorted(start, low + len(node)))] - low, 0)
            running[first : first + len(cuts)] += np.add.reduceat(score, cuts)
        return running, np.concatenate(rare), np.concatenate(owner)


_scorers: dict[str, Scorer] = {}


def _score(name: str, frequent, hot, logs, groups: int, node_groups: int):
    """Of each block of texts, a row for each text, with its scores so far, and one for each group of rarer words, or nodes, with those of all its texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(*frequent.value)
        scorer, words, log_of, known_of = _scorers[name], hot.value, *logs.value
        for batch in batches:
            for block in blocks(batch.column(3), SPACED):
                low, high = block.rows
                n = high - low
                row = batch.column(0).slice(low, n)
                train = ~batch.column(2).slice(low, n).to_numpy(zero_copy_only=False)
                ppm, rare, of_text = scorer.texts(block.data, block.begin)
                owner = np.repeat(np.arange(n), np.diff(block.first))
                order = np.lexsort((block.hashes, owner))
                h, o = block.hashes[order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
                h, o, count = h[new], o[new], np.diff(np.append(new, len(h)))
                at, is_hot = _find(words, h)
                base = np.bincount(o[is_hot], weights=(log_of[at] * count)[is_hot] if len(words) else None, minlength=n)[:n].astype(np.float64)
                n_known = np.bincount(o[is_hot], weights=(known_of[at] * count)[is_hot] if len(words) else None, minlength=n)[:n].astype(np.int64)
                number = row[0].as_py()
                yield _scored(_TEXT, np.full(n, number), row, batch.column(1).slice(low, n), batch.column(2).slice(low, n), np.diff(block.first) + 1, n_known, base, ppm)
                if len(rare):
                    of_group = (rare * _SPREAD >> 16) % node_groups
                    order = np.lexsort((rare, of_text, of_group))
                    rare, of_text, of_group = rare[order], of_text[order], of_group[order]
                    new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (of_text[1:] != of_text[:-1])]))
                    times = np.diff(np.append(new, len(rare)))
                    rare, of_text, of_group = rare[new], of_text[new], of_group[new]
                    cuts = np.flatnonzero(np.concatenate([[True], of_group[1:] != of_group[:-1]]))
                    packed = [[x.tobytes() for x in np.split(column, cuts[1:])] for column in (rare, row.to_numpy()[of_text], times)]
                    yield _scored(_NODES, np.full(len(cuts), number), of_group[cuts], *packed)
                h, o, count = h[~is_hot], o[~is_hot], count[~is_hot]
                group = ((h >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
                sort = np.argsort(group, kind="stable")
                h, o, count, group = h[sort], o[sort], count[sort], group[sort]
                if not len(group):
                    continue
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                packed = [[x.tobytes() for x in np.split(column, cuts[1:])] for column in (h, row.to_numpy()[o], np.where(train[o], count, -count))]
                yield _scored(_RARE, np.full(len(cuts), number), group[cuts], *packed)

    return score


_TEXT = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("ppm", pa.float64())])
_RARE = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("hashes", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary())])
_NODES = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("nodes", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary())])
_SCORED = pa.unify_schemas([_TEXT, _RARE, _NODES])
_SCORED_DDL = "block long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, ppm double, group long, hashes binary, rows binary, counts binary, nodes binary"
_SUMS_DDL = "block long, rows binary, known binary, sums binary, words long"
_NODE_SUMS = pa.schema([("block", pa.int64()), ("node_rows", pa.binary()), ("node_sums", pa.binary())])
#: Spreads nodes over groups; the product of it and a node is below 2^63.
_SPREAD = 0x61C88647


def _scored(schema: pa.Schema, *columns: pa.Array | np.ndarray | list) -> pa.RecordBatch:
    """A batch with the columns of ``schema``; those of the other kind of row are null."""
    own = {f.name: x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(schema, columns, strict=True)}
    n = len(own["block"])
    return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in _SCORED], schema=_SCORED)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]])


def _meet(table: pa.Table) -> pa.Table:
    """Sums over the rarer words of a group by text, packed: a row for each block that sent some.

    One more row, of block -1, has the number of distinct words in training texts. A block's rows are consecutive
    numbers from that of the block.
    """
    h, row, signed = (_joined(table.column(c), t) for c, t in (("hashes", np.uint64), ("rows", np.int64), ("counts", np.int64)))
    _, word = np.unique(h, return_inverse=True)
    count = np.abs(signed)
    c = np.bincount(word, weights=np.where(signed > 0, signed, 0))
    texts, text = np.unique(row, return_inverse=True)
    base = np.bincount(text, weights=np.log10(c[word] + 0.5) * count)
    known = np.bincount(text, weights=(c[word] > 0) * count).astype(np.int64)
    block = np.unique(table.column("block").to_numpy())
    cuts = np.searchsorted(texts, block)[1:]
    packed = [[*[x.tobytes() for x in np.split(column, cuts)], None] for column in (texts, known, base)]
    words = pa.array([*[None] * len(block), int((c > 0).sum())], pa.int64())
    return pa.table([pa.array(np.append(block, -1)), *[pa.array(x, pa.binary()) for x in packed], words], ["block", "rows", "known", "sums", "words"])


def _meet_nodes(asked: pa.Table, chances: pa.Table) -> pa.Table:
    """Sums over the rarer nodes of a group by text, packed: a row for each block that sent some."""
    node, row, count = (_joined(asked.column(c), np.int64) for c in ("nodes", "rows", "counts"))
    if not len(node):
        return _NODE_SUMS.empty_table()
    chances = chances.sort_by("key")
    chance = chances.column("chance").to_numpy()[np.searchsorted(chances.column("key").to_numpy(), node)]
    texts, text = np.unique(row, return_inverse=True)
    block = np.unique(asked.column("block").to_numpy())
    cuts = np.searchsorted(texts, block)[1:]
    packed = [[x.tobytes() for x in np.split(column, cuts)] for column in (texts, np.bincount(text, weights=chance * count))]
    return pa.table([pa.array(block), *[pa.array(x, pa.binary()) for x in packed]], schema=_NODE_SUMS)


def _total(table: pa.Table) -> pa.Table:
    """The texts of a block with what its rarer words and nodes add."""
    texts = table.filter(table.column("row").is_valid()).sort_by("row")
    known, base = texts.column("n_known").to_numpy().copy(), texts.column("base").to_numpy().copy()
    at = np.searchsorted(texts.column("row").to_numpy(), _joined(table.column("rows"), np.int64))
    np.add.at(known, at, _joined(table.column("known"), np.int64))
    np.add.at(base, at, _joined(table.column("sums"), np.float64))
    ppm = texts.column("ppm").to_numpy().copy()
    if "node_rows" in table.column_names:
        np.add.at(ppm, np.searchsorted(texts.column("row").to_numpy(), _joined(table.column("node_rows"), np.int64)), _joined(table.column("node_sums"), np.float64))
    return pa.table([texts.column("doc_id"), texts.column("held_out"), texts.column("n_tokens"), pa.array(known), pa.array(base), pa.array(ppm)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])


def _hot_words(training: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), SPACED):
                key, n = np.unique(block.hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = training.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "key").limit(HOT_WORDS).select("key").toPandas()
    return np.sort(found["key"].to_numpy().astype(np.int64).view(np.uint64))


def score(docs: DataFrame, work: Workspace) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows that aren't held out. A null text is an empty one, with the end as its only token. Without
    training texts every token is unknown and every byte equally likely. Rows with null or repeated ids are scored each
    for itself. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    training = docs.where(~F.col("held_out"))
    hot = spark.sparkContext.broadcast(_hot_words(training.where(F.pmod(F.monotonically_increasing_id(), F.lit(SAMPLE)) == 0).select("text")))
    counted = work.table(docs.select("text", "held_out").mapInArrow(_count(hot), "kind string, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    scalars = {r["key"]: r["n"] for r in counted.where("kind = 't'").collect()}
    tokens, texts = scalars.get(0, 0), scalars.get(1, 0)
    asked = counted.where("kind = 'n'")
    low = asked.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    below = spark.sparkContext.broadcast((low["key"].to_numpy().astype(np.int64), low["n"].to_numpy().astype(np.int64)))
    size = asked.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    part = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(max(1, -(-size["nodes"] // PART))))
    chances = work.table(asked.select(part.alias("part"), "key", "n", "m").groupBy("part").applyInArrow(_chances(below), "key long, m long, chance double"), "chances")
    top = chances.orderBy(F.desc("m"), "key").limit(NODES).toPandas()
    last = (int(top["m"].iloc[-1]), int(top["key"].iloc[-1])) if len(top) else (0, 0)
    node_groups = max(1, -(-(size["m"] - int(top["m"].sum())) // GROUP))
    top = top.sort_values("key")
    frequent = spark.sparkContext.broadcast((top["key"].to_numpy().astype(np.int64), top["m"].to_numpy().astype(np.int64), top["chance"].to_numpy().astype(np.float64)))
    by_word: pd.DataFrame = counted.where("kind = 'w'").select("key", "n").toPandas()
    of_hot = np.zeros(len(hot.value), np.int64)
    if len(by_word):
        of_hot[np.searchsorted(hot.value, by_word["key"].to_numpy().view(np.uint64))] = by_word["n"].to_numpy()
    logs = spark.sparkContext.broadcast((np.log10(of_hot + 0.5), (of_hot > 0).astype(np.int64)))
    groups = max(1, -(-tokens // GROUP))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    scored = work.table(numbered.select("row", "doc_id", "held_out", "text").mapInArrow(_score(work.path, frequent, hot, logs, groups, node_groups), _SCORED_DDL), "scored")
    rare = scored.where(F.col("hashes").isNotNull()).select("block", "group", "hashes", "rows", "counts")
    met = work.table(rare.groupBy("group").applyInArrow(_meet, _SUMS_DDL), "met")
    distinct = int((of_hot > 0).sum()) + (met.agg(F.sum("words")).first()[0] or 0) + (1 if texts else 0)
    every = scored.where(F.col("row").isNotNull()).select("block", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ppm")
    every = every.unionByName(met.where("block >= 0").drop("words"), allowMissingColumns=True)
    if size["nodes"] > NODES:
        rarer = chances.where((F.col("m") < last[0]) | ((F.col("m") == last[0]) & (F.col("key") > last[1])))
        rarer = rarer.select(F.pmod(F.shiftright(F.col("key") * F.lit(_SPREAD), 16), F.lit(node_groups)).alias("group"), "key", "chance")
        sent = scored.where(F.col("nodes").isNotNull()).select("group", "block", "nodes", "rows", "counts")
        found = sent.groupBy("group").cogroup(rarer.groupBy("group")).applyInArrow(_meet_nodes, "block long, node_rows binary, node_sums binary")
        every = every.unionByName(found, allowMissingColumns=True)
    sums = every.groupBy("block").applyInArrow(_total, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    whole = float(np.log10(tokens + 0.5 * (distinct + 1)))
    end = float(np.log10(texts + 0.5))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(1 if texts else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )
