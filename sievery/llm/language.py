"""Language identification by rank-order profiles.

A language is the ranking of its most frequent letter n-grams (one to three letters of words padded with a space). A
document is ranked in the same way, and its language is the one whose ranking is least out of place: for each of the
document's n-grams the difference of the two ranks, or the length of a profile where the language lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievery.llm.words import release

#: N-grams of a profile.
LENGTH = 300
#: Letters of a text that are counted at a time.
PIECE = 1 << 19
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 1 << 21
UNKNOWN = "und"

_tables: tuple[np.ndarray, np.ndarray] | None = None


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, whether it is a letter, and its lower case where that is one code point."""
    global _tables
    if _tables is None:
        alpha, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.int32)
        for low in range(0, 0x110000, 1 << 12):
            # Surrogates are no letters; a slice at a time keeps the strings few.
            chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(low, low + (1 << 12))]
            alpha[low : low + (1 << 12)] = [c.isalpha() for c in chars]
            small = [c.lower() for c in chars]
            lower[low : low + (1 << 12)] = [ord(x) if len(x) == 1 else low + i for i, x in enumerate(small)]
        lower[0xD800:0xE000] = 32
        _tables = alpha, lower
    return _tables


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as numbers that hold their code points, and their counts."""
    alpha, lower = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = []
    last = np.array([32, 32], dtype=np.int64)
    for at in range(0, len(points) + 1, PIECE):
        piece = lower[points[at : at + PIECE]].astype(np.int64)
        letter = alpha[piece]
        padded = np.concatenate([last, np.where(letter, piece, 32)])
        if at + PIECE > len(points):
            padded = np.append(padded, 32)
        keep = np.ones(len(padded), bool)
        keep[2:] = (padded[2:] != 32) | (padded[1:-1] != 32)
        s = padded[keep]
        a, b, c = s[:-2], s[1:-1], s[2:]
        if len(c):
            # N-grams that end with a letter of this piece, or with the space after one.
            codes = np.concatenate([c[c != 32], (b << 21 | c)[(b != 32) | (c != 32)], (a << 42 | b << 21 | c)[(b != 32)]])
            found.append(np.unique(codes, return_counts=True))
        last = s[-2:]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else _added(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]))


def ranked(codes: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:length]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = _added(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = held.setdefault(lang, [])
            parts.append(grams(text))
            size += len(parts[-1][0])
            if len(parts) >= 512:
                held[lang] = [_added(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))]
                size = sum(len(c) for p in held.values() for c, _ in p)
        if size > HELD:
            yield from flush()
            held, size = {}, 0
    yield from flush()
    release()


def learn(docs: DataFrame, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Profiles from all rows of ``docs`` (lang, text) that have both: n-grams by rank.

    The driver gets ``length`` n-grams for each language.
    """
    counted = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_count, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = totals.withColumn("place", place).where(F.col("place") <= length).select("lang", "place", "gram").collect()
    profiles: dict[str, list[int]] = {}
    for lang, _, gram in sorted(rows):
        profiles.setdefault(lang, []).append(gram)
    return {lang: np.array(p, dtype=np.int64) for lang, p in profiles.items()}


def _lookup(profiles: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    return [(lang, np.sort(p), np.argsort(p, kind="stable")) for lang, p in sorted(profiles.items())]


def compared(text: str | None, lookup: list[tuple[str, np.ndarray, np.ndarray]], length: int = LENGTH) -> tuple[str, float, list[float]]:
    """The language of a text, and how far its ranking is from being wholly out of place (0 to 1), there and in each language."""
    own = ranked(*grams(text or ""), length)
    if not len(own) or not lookup:
        return UNKNOWN, 0.0, []
    place, best, scores = np.arange(len(own)), (UNKNOWN, -1), []
    for lang, codes, ranks in lookup:
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        distance = int(np.where(codes[at] == own, np.abs(ranks[at] - place), length).sum())
        if best[1] < 0 or distance < best[1]:
            best = (lang, distance)
        scores.append(max(0.0, 1.0 - distance / (length * len(own))))
    return best[0], max(scores), scores


def closest(text: str | None, lookup: list[tuple[str, np.ndarray, np.ndarray]], length: int = LENGTH) -> tuple[str, float]:
    """The language of a text and its score there."""
    return compared(text, lookup, length)[:2]


def predicted(spark, text: Column, profiles: dict[str, np.ndarray]) -> Column:
    """A struct of ``lang``, ``score`` and ``scores``, by language in code point order, for each text.

    A text that is null or has no letters has the language ``und`` with score 0, and no scores.

    Ties go to the language that is first in code point order. Texts are read whole, in pieces of bounded size.
    """
    shared = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang: string, score: double, scores: array<double>>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup = _lookup(shared.value)
        for texts in batches:
            lang, score, scores = zip(*[compared(t.as_py(), lookup) for t in texts], strict=True) if len(texts) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(scores, pa.list_(pa.float64()))], ["lang", "score", "scores"])
        release()

    return predict(text.cast("string"))


def least_score(told: DataFrame, langs: list[str]) -> float:
    """The score that tells texts in a language from others, from labelled texts: midway between what all but a hundredth
    of them have in their own language and what half of them have in another one, which is as near as unlearned ones come.

    ``told`` has ``lang`` and ``scores``, in the order of ``langs``. Scores count to a thousandth; without labelled texts it is 0.
    """
    each = told.where(F.col("lang").isNotNull()).select("lang", F.posexplode("scores").alias("at", "score"))
    own = F.element_at(F.array(*[F.lit(x) for x in langs]), F.col("at") + 1) == F.col("lang")
    rows = each.groupBy(own.alias("own"), F.floor(F.col("score") * 1000).alias("bin")).count().collect() if langs else []
    found = []
    for mine, share in ((True, 0.01), (False, 0.5)):
        bins = sorted((r["bin"], r["count"]) for r in rows if r["own"] == mine)
        below = np.cumsum([n for _, n in bins])
        found.append(bins[int(np.searchsorted(below, share * below[-1]))][0] / 1000 if bins else 0.0)
    return min(found[0], sum(found) / 2)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: a third, by the CRC of the id; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
