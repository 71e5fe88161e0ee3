"""Words of whole texts as 64-bit hashes, computed over Arrow buffers.

The hot loops of the text operators need words, not strings: positions, equality and sets. This module finds the
words of a column of texts with a few NumPy passes over the UTF-8 bytes, a bounded block at a time, so that neither a
batch of many texts nor one very long text needs more than a small multiple of its own size.

A word is a maximal run of bytes of one class; ``A-Z`` counts as ``a-z`` unless letters are not folded. Equal words have
equal hashes: a sum of the bytes with a weight of its own, odd and fixed, for each place. Words that differ in few or many
places alike then meet by chance only, for two given words about once in 2**56; where that would matter, compare bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text taken at a time. Temporary arrays need about 40 bytes for each.
BLOCK = 1 << 18
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Everything but ASCII white space.
SPACED = _byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Digits, letters and every byte outside ASCII.
PLAIN = _byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_weights = np.zeros(0, dtype=np.uint64)


def _weights_of(n: int) -> np.ndarray:
    """Weights of the first ``n`` places of a word, or more; they are kept for words of usual length."""
    global _weights
    if len(_weights) >= n:
        return _weights
    made = mix(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)
    if n <= 1 << 16:
        _weights = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give memory that a worker has freed back to the system, at the end of a task that held whole texts or sets, for idle workers keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While it lasts, Arrow batches that go to Python end at ``size`` bytes, for rows that hold whole texts or sets."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class Block:
    """Words of the texts ``rows[0]`` to ``rows[1]`` of an array, those of text i at ``first[i]`` to ``first[i + 1]``.

    ``start`` and ``length`` are in bytes of ``data``; text i begins there at byte ``begin[i]``.
    """

    rows: tuple[int, int]
    data: np.ndarray
    begin: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the offsets of its texts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _scan(data: np.ndarray, begin: np.ndarray, inside_of: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word of ``data``; no word crosses a position in ``begin``."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return empty
    inside = inside_of[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = begin[begin < len(data)]
    opens[cut] = inside[cut]
    start = np.flatnonzero(opens)
    if not len(start):
        return empty
    at = np.arange(len(data), dtype=np.int64)
    at[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(data))))
    at[~inside] = 0
    value = (_LOWER[data] if fold else data).astype(np.uint64)
    value += np.uint64(1)
    value *= _weights_of(int(at.max()) + 1)[at]
    value[~inside] = 0
    length = np.add.reduceat(inside.astype(np.int64), start)
    return mix(np.add.reduceat(value, start) + length.astype(np.uint64) * _LENGTH), start, length


def blocks(column: pa.Array | pa.ChunkedArray, inside_of: np.ndarray = SPACED, size: int = BLOCK, fold: bool = True) -> Iterator[Block]:
    """The words of a column of texts, in blocks of whole texts of about ``size`` bytes, or of one longer text. ``fold``: ``A-Z`` counts as ``a-z``."""
    data, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        piece = data[offsets[low] : offsets[high]]
        begin = offsets[low : high + 1] - offsets[low]
        if len(piece) <= 2 * size:
            hashes, start, length = _scan(piece, begin[:-1], inside_of, fold)
        else:
            parts, at = [], 0
            while at < len(piece):
                end = min(at + size, len(piece))
                while end < len(piece) and inside_of[piece[end]]:
                    end += 1
                got = _scan(piece[at:end], np.zeros(1, np.int64), inside_of, fold)
                parts.append((got[0], got[1] + at, got[2]))
                at = end
            hashes, start, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield Block((low, high), piece, begin, hashes, start, length, np.searchsorted(start, begin).astype(np.int64))
        low = high


_ODD = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)
_SHORT = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64) * _MULTIPLIER)


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words of each text, in order and with repeats, and their offsets by text.

    A text of one to four words has one: the whole sequence. A text without words has none.
    """
    words = np.diff(first)
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.repeat(first[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    left = np.repeat(words, count)
    total = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        total += np.where(left > k, padded[at + k] * _ODD[k], np.uint64(0))
    short = left < SHINGLE
    total[short] += _SHORT[left[short]]
    return mix(total), offsets


def runs(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``length`` words, fewer than five, of each text, and their offsets by text: a run's is that of a text of just these words."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.repeat(first[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    return mix(np.add.reduce([hashes[at + k] * _ODD[k] for k in range(length)]) + _SHORT[length]), offsets


def shingle_sets(column: pa.Array | pa.ChunkedArray, lengths: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column, with those of its runs of ``lengths`` words."""
    for block in blocks(column):
        found = [shingles(block.hashes, block.first), *[runs(block.hashes, block.first, k) for k in lengths]]
        for i in range(len(block.first) - 1):
            yield np.unique(np.concatenate([h[o[i] : o[i + 1]] for h, o in found]))
