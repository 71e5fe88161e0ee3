"""Collocations: phrases of two to four words that stick together, with exact counts.

Texts are taken in parts of bounded size. A first pass sketches all words and phrases: each adds to one cell of a table that
is wider than the texts have phrases, so a cell's sum bounds the counts of its phrases from above. Parts hand on the cells
that they touched, in blocks, and blocks are summed where they meet; each part is told which of its own cells are heavy.
The second pass joins the parts with these. A part's phrases in heavy cells are its candidates, as many as its own texts have
at most. They are compiled into Aho-Corasick automata over coded words: each word of a candidate is a code of some letters,
with letters of its own for each place of the code, and all other words and the ends of pieces are a delimiter, so no match
starts or ends within a word or crosses a piece. The part is scanned with them, overlapping matches are counted, and the
parts' counts of a phrase are summed; then the thresholds apply.

A phrase that occurs often enough lies in a heavy cell, and so all parts that have it count it; what a cell lets through
wrongly is counted exactly and dropped. Texts are read twice, however many candidates there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat
from math import ceil
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.llm.words import Block, _byte_class, blocks, mix, release, small_batches
from sievery.storage import Workspace

#: Words of a phrase, at least and at most.
SHORTEST, LONGEST = 2, 4
LEAST = 30
TOP = 2000
#: A candidate inside a longer one with so many hundredths of its count is dropped.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Candidates of an automaton, some hundred bytes each. A part that has more is scanned with several.
BATCH = 1 << 20
#: Bytes of text of a part.
PART = 1 << 24
#: Letters for a place of a word's code: few, for automata look for the next letter one by one.
LETTERS = 60
#: Blocks that the sketch is dealt out in, and cells for each two bytes of text, as powers of two.
BLOCKS, SPARE = 11, 10
#: Bits of a cell, at least and at most.
BITS = 16, 60
#: Words and phrases that a part holds before it passes their cells on.
HELD = 1 << 22
#: Blocks that counts are dealt out in, as a power of two.
SUMS = 10
#: Bytes of text that are coded at a time.
PIECE = 1 << 20
#: Tasks that rank the candidates of a language before one takes the best of these.
CELLS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PHRASE = _byte_class([(0x20, 0x20), (0x09, 0x09), *[(b, b) for b in _BREAKS]])
_IS_BREAK = ~_byte_class([(b, b) for b in _BREAKS])
_BREAK = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Phrases:
    """The words and phrases of a block of texts: hash, number of words, and which of the block's words is the first."""

    def __init__(self, block: Block, langs: list[str]):
        self.block, self.text = block, np.repeat(np.arange(len(langs)), np.diff(block.first))
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], dtype=np.uint64)
        # Pieces of all texts, numbered by the breaks before them.
        piece = np.searchsorted(np.flatnonzero(_IS_BREAK[block.data]), block.start) + self.text * (len(block.data) + 1)
        found, value = [], mix(block.hashes ^ salts[self.text])
        for words in range(1, LONGEST + 1):
            if words > 1:
                value = mix(value[:-1] * _ODD + block.hashes[words - 1 :])
            at = np.flatnonzero(piece[words - 1 :] == piece[: max(0, len(piece) - words + 1)])
            found.append((value[at], at, np.full(len(at), words)))
        self.hashes, self.first, self.words = (np.concatenate(x) for x in zip(*found, strict=True))

    def spelled(self, at: np.ndarray) -> list[bytes]:
        """Phrases, with one space between words."""
        block, first, last = self.block, self.first[at], self.first[at] + self.words[at] - 1
        data, total = block.data.tobytes().lower(), np.cumsum(block.length)
        start, end = block.start[first], block.start[last] + block.length[last]
        found = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if b"\t" in data:
            return [b" ".join(p.split()) for p in found]
        for i in np.flatnonzero(end - start != total[last] - total[first] + block.length[first] + self.words[at] - 1).tolist():
            found[i] = b" ".join(found[i].split())
        return found


def _phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Phrases, list[str]]]:
    """Phrases of batches (lang, text), a block of texts at a time, and the languages of these."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in blocks(batch.column(1), _PHRASE):
            of_block = langs[block.rows[0] : block.rows[1]]
            yield Phrases(block, of_block), of_block


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the part, their first column, changes; without it."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low < high:
                yield int(part[low]), batch.select(batch.schema.names[1:]).slice(low, high - low)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, those of equal weight together, which shuffles compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(values: bytes) -> np.ndarray:
    return np.frombuffer(values, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _sketch(bits: int):
    """Cells of each part's phrases, as differences, with counts, by block: the first bits of a cell."""
    inner = np.uint64(bits - min(BLOCKS, bits))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = -1

        def flush() -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            block, first = np.unique(cells >> inner, return_index=True)
            ends = np.append(first, len(cells))
            rows = [(packed(np.diff(cells[a:b], prepend=np.uint64(0))), packed(counts[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.RecordBatch.from_pydict({"block": pa.array(block.astype(np.int64)), "part": pa.array([now] * len(rows), pa.int32()), "cells": pa.array([c for c, _ in rows], pa.binary()), "counts": pa.array([n for _, n in rows], pa.binary())})

        for part, run in _runs(batches):
            if part != now and held:
                yield flush()
            now = part
            for phrases, _ in _phrases([run]):
                held.append(phrases.hashes >> np.uint64(64 - bits))
                if sum(map(len, held)) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return sketch


def _heavy(least: int):
    """For each part of a block, those of its cells that have a sum of ``least`` or more, as differences."""

    def heavy(parts: pa.Table) -> pa.Table:
        each = [np.cumsum(unpacked(c), dtype=np.uint64) for c in parts["cells"].to_pylist()]
        counts = np.concatenate([unpacked(n) for n in parts["counts"].to_pylist()]).astype(np.int64)
        part = np.repeat(parts["part"].to_numpy(), [len(c) for c in each])
        cells, at = np.unique(np.concatenate(each), return_inverse=True)
        some = np.flatnonzero((np.bincount(at, counts, len(cells)) >= least)[at])
        some = some[np.lexsort((at[some], part[some]))]
        part, at = part[some], at[some]
        new = np.append(True, (np.diff(part) != 0) | (np.diff(at) != 0))[: len(at)]
        part, at = part[new], at[new]
        of, first = np.unique(part, return_index=True)
        ends = np.append(first, len(at))
        rows = [packed(np.diff(cells[at[a:b]], prepend=np.uint64(0))) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"part": pa.array(of.astype(np.int32)), "cells": pa.array(rows, pa.binary())})

    return heavy


class Automaton:
    """The candidates of a language, words and phrases, in an automaton over coded words."""

    def __init__(self, places: np.ndarray, phrases: list[bytes]):
        self.places, self.counts = places, np.zeros(len(places), np.int64)
        words = [i for i, p in enumerate(phrases) if b" " not in p]
        self.known = {phrases[i]: k + 1 for k, i in enumerate(words)}
        self.words = np.array([0, *words], np.int64)
        # The code of word 0, the delimiter, is zeros, which no candidate has.
        self.letters, n = 1, len(words) + 1
        while LETTERS**self.letters < n:
            self.letters += 1
        left, codes = np.arange(n), []
        for place in range(self.letters):
            codes.append(left % LETTERS + place * LETTERS + 1)
            left //= LETTERS
        self.codes = np.stack(codes[::-1], axis=1).astype(np.uint8)
        self.codes[0] = 0
        self.automaton = ahocorasick.Automaton()
        longer = [i for i, p in enumerate(phrases) if b" " in p]
        # One split of all, for many small lists are dear.
        each = b" ".join([phrases[i] for i in longer]).split(b" ") if longer else []
        coded = self.coded(np.fromiter(map(self.known.__getitem__, each), np.int64, len(each)))
        ends = (np.cumsum([phrases[i].count(b" ") + 1 for i in longer], dtype=np.int64) * self.letters).tolist()
        for i, low, high in zip(longer, [0, *ends], ends, strict=False):
            self.automaton.add_word(coded[low:high], i)
        if len(self.automaton):
            self.automaton.make_automaton()

    def coded(self, words: list[int] | np.ndarray) -> str:
        return self.codes[words].tobytes().decode("latin-1")

    def scan(self, texts: list[bytes]) -> int:
        """Count the candidates in ``texts``; the number of words."""
        total, seen, lines = 0, np.zeros(len(self.words), np.int64), []
        for words in _pieces(texts):
            total += len(words) - words.count(b".")
            known = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
            seen += np.bincount(known, minlength=len(seen))
            lines.append(self.coded(known))
        self.counts[self.words[1:]] += seen[1:]
        if len(self.automaton):
            self.counts += np.bincount(np.fromiter(map(itemgetter(1), self.automaton.iter("".join(lines))), np.int64), minlength=len(self.counts))
        return total


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Lower-case words of the texts, with a ``.`` for breaks and between texts, some at a time."""
    held, size = [], 0
    for text in texts:
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end] not in b" \t":
                end += 1
            held.append(text[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield _BREAK.sub(b" . ", b" ".join(held).lower()).split()
                held, size = [], 0
        held.append(b".")
    yield _BREAK.sub(b" . ", b" ".join(held).lower()).split()


def _candidates(texts: list[pa.RecordBatch], heavy: np.ndarray, bits: int) -> dict[str, tuple[list[bytes], list[int]]]:
    """The distinct words and phrases of ``texts`` in cells of ``heavy``, and their blocks, by language."""
    found: dict[str, tuple[list[bytes], list[int]]] = {}
    known, met = set(), np.zeros(len(heavy), bool)
    for phrases, langs in _phrases(texts) if len(heavy) else ():
        hashes, at = np.unique(phrases.hashes, return_index=True)
        cells = hashes >> np.uint64(64 - bits)
        place = np.minimum(np.searchsorted(heavy, cells), len(heavy) - 1)
        some = np.flatnonzero(heavy[place] == cells)
        met[place[some]] = True
        some = some[np.fromiter((h not in known for h in hashes[some].tolist()), bool, len(some))]
        known.update(hashes[some].tolist())
        at, block = at[some], (hashes[some] >> np.uint64(64 - SUMS)).tolist()
        for text, phrase, b in zip(phrases.text[phrases.first[at]].tolist(), phrases.spelled(at), block, strict=True):
            own = found.setdefault(langs[text], ([], []))
            own[0].append(phrase)
            own[1].append(b)
    if not met.all():
        raise RuntimeError("a part has other texts than in the pass before: its table is not read in the same order each time")
    return found


def _counted(texts: list[bytes], phrases: list[bytes], batch: int) -> tuple[np.ndarray, int]:
    """How often each of ``phrases``, words and longer ones, occurs in ``texts``, and the number of words."""
    counts, total = np.zeros(len(phrases), np.int64), 0
    single, longer = ([i for i, p in enumerate(phrases) if (b" " in p) == long] for long in (False, True))
    for low in range(0, max(1, len(longer)), batch):
        own, some = [] if low else single, longer[low : low + batch]
        first, last = [phrases[i] for i in own], [phrases[i] for i in some]
        words = list(set(b" ".join(last).split()).difference(first))
        automaton = Automaton(np.arange(len(first) + len(words) + len(last)), [*first, *words, *last])
        total = automaton.scan(texts)
        counts[own], counts[some] = automaton.counts[: len(first)], automaton.counts[len(first) + len(words) :]
    return counts, total


def _count(bits: int, batch: int):
    """Counts of each part's candidates by block, and at block -1 its words, by language; a part's cells come before its texts."""

    def counted(texts: list[pa.RecordBatch], cells: list[bytes]) -> pa.RecordBatch:
        heavy = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unpacked(c), dtype=np.uint64) for c in cells)]))
        candidates, by_lang, rows = _candidates(texts, heavy, bits), {}, []
        for run in texts:
            for lang, text in zip(run.column(0).to_pylist(), run.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            phrases, block = candidates.get(lang, ([], []))
            counts, total = _counted(own, phrases, batch)
            block = np.array(block, np.int64)
            order = np.argsort(block, kind="stable")
            blocks_of, first = np.unique(block[order], return_index=True)
            ends = np.append(first, len(order))
            rows.append((-1, lang, None, packed(np.array([total]))))
            rows += [(b, lang, b"\n".join([phrases[i] for i in order[low:high].tolist()]), packed(counts[order[low:high]])) for b, low, high in zip(blocks_of.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        block, lang, phrases, counts = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(lang, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())], ["block", "lang", "phrases", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, texts = -1, [], []
        for part, run in _runs(batches):
            if part != now:
                if texts or cells:
                    yield counted(texts, cells)
                now, cells, texts = part, [], []
            cells += run.column(0).drop_null().to_pylist()
            texts.append(run.select(["lang", "text"]).filter(run.column(0).is_null()))
        if texts or cells:
            yield counted(texts, cells)
        release()

    return count


def _added(least: int):
    """Phrases of a block that occur ``least`` times or more, with their counts; of block -1 the words of each language."""

    def added(parts: pa.Table) -> pa.Table:
        sums: dict[str, dict[bytes | None, int]] = {}
        for lang, phrases, counts in zip(*(parts[c].to_pylist() for c in ("lang", "phrases", "counts")), strict=True):
            own = sums.setdefault(lang, {})
            for phrase, n in zip([None] if phrases is None else phrases.split(b"\n"), unpacked(counts).tolist(), strict=True):
                own[phrase] = own.get(phrase, 0) + n
        rows = [(lang, p, 0 if p is None else p.count(b" ") + 1, n) for lang, own in sums.items() for p, n in own.items() if p is None or n >= least]
        lang, phrase, words, n = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.binary()).cast(pa.string()), "words": pa.array(words, pa.int32()), "n": pa.array(n, pa.int64())})

    return added


def counted(docs: DataFrame, work: Workspace, least: int = LEAST, batch: int = BATCH, spare: int = SPARE) -> tuple[DataFrame, DataFrame]:
    """Words and phrases that occur ``least`` times or more with their exact counts (lang, phrase, words, n), and all words by language (lang, n).

    ``docs`` is read twice and has to give the same rows in the same order each time, as files do.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.select(F.spark_partition_id().alias("p"), F.octet_length("text").alias("size")).groupBy("p").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    size = sum(r["size"] for r in sizes)
    bits = min(max(BITS[0], (size // 2).bit_length() + spare), BITS[1])
    each = max([1, *(ceil(r["size"] / PART) for r in sizes)])
    rows = max([1, *(ceil(r["rows"] / each) for r in sizes)])
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    part = (F.spark_partition_id() * each + F.least((row / rows).cast("int"), F.lit(each - 1))).cast("int")
    texts = texts.select(part.alias("part"), "lang", "text")
    parts = each * (1 + max([0, *(r["p"] for r in sizes)]))
    with small_batches(docs.sparkSession):
        sketch = texts.mapInArrow(_sketch(bits), "block long, part int, cells binary, counts binary")
        heavy = sketch.groupBy("block").applyInArrow(_heavy(least), "part int, cells binary")
        both = heavy.unionByName(texts, allowMissingColumns=True).repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("cells").isNull())
        counts = both.mapInArrow(_count(bits, batch), "block long, lang string, phrases binary, counts binary")
        sums = work.table(counts.groupBy("block").applyInArrow(_added(least), "lang string, phrase string, words int, n long"), "counts")
    return sums.where("words > 0"), sums.where("words = 0").select("lang", "n")


def _part(words: Column, first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, work: Workspace, least: int = LEAST, top: int = TOP, batch: int = BATCH, spare: int = SPARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language of ``docs`` (lang, text).

    a, l and r count the phrase and the parts of its lowest-scoring cut, n the words of the language; the score is ``SCALE * a / (l + r)``,
    rounded down. Phrases occur ``least`` times or more, and none lies in a longer one that has ``COVERED`` hundredths of its count. Ties go to
    the more frequent phrase, then to the smaller one by its bytes. A null lang is ``und``; null and empty texts have no words, and an empty
    table has no phrases. Rows that repeat count each time, whatever their ids; texts of any length are read whole, pieces of theirs at a time.
    Other columns are not read.
    """
    counts, totals = counted(docs, work, least, batch, spare)
    frequent = counts.where((F.col("words") >= SHORTEST) & (F.col("n") >= least))
    one = F.split("phrase", " ")
    cuts = frequent.select("lang", "phrase", F.col("n").alias("a"), one.alias("one"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("one"), 1, F.col("k")).alias("left"), _part(F.col("one"), F.col("k") + 1, F.size("one")).alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])), ["lang", side])
    # As decimals, for products of counts pass 64 bits.
    score = F.expr(f"cast({SCALE} as decimal(38, 0)) * a div (cast(l as decimal(38, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spans = [(first, length) for words in range(SHORTEST + 1, LONGEST + 1) for length in range(SHORTEST, words) for first in range(1, words - length + 2)]
    inner = F.array(*[F.when(F.size(one) > length, F.when(F.size(one) >= first + length - 1, _part(one, first, length))) for first, length in sorted(set(spans))])
    longer = frequent.where(F.col("words") > SHORTEST).select("lang", "n", F.explode(F.array_compact(inner)).alias("phrase"))
    covering = longer.groupBy("lang", "phrase").agg(F.max("n").alias("covering"))
    kept = scored.join(covering, ["lang", "phrase"], "left").where(F.col("covering").isNull() | (F.col("covering").cast("decimal(38, 0)") * 100 < F.col("a").cast("decimal(38, 0)") * COVERED))
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    best = kept.withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(CELLS)))
    for keys in (["lang", "cell"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals) if totals.count() <= CELLS else totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), found AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM words, range(1, 5) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)
), f AS (
    SELECT lang, k, phrase, count(*) AS a FROM found GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
    SELECT c.lang, c.phrase, c.a, j.j, string_split(c.phrase, ' ') AS w FROM f c, range(1, 4) AS j(j) WHERE j.j < c.k
), scored AS (
    SELECT c.*, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score
    FROM cuts c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.j], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1:], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_phrases AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS covering
    FROM (SELECT DISTINCT lang, phrase, a, w FROM cuts), range(2, 4) AS t(m), range(1, 4) AS u(i)
    WHERE m < len(w) AND i + m - 1 <= len(w) GROUP BY ALL
), kept AS (
    SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY o.score DESC, o.a DESC, o.phrase) AS rank
    FROM lowest o LEFT JOIN inner_phrases i USING (lang, phrase) WHERE i.covering IS NULL OR 100 * i.covering < 80 * o.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""
