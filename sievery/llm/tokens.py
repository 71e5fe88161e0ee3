"""Token ids in Arrow files of equal-length sequences.

Documents in ascending order of their ids become one stream of token ids, each closed by an end id. The stream is cut
into files, one for each range of ids, and a file into record batches of fixed-size lists: sequences of token ids, and
masks that are false where the last sequence is padded. All of a batch's ids are one buffer, so with a memory map token
i of a file is found by division and read without a copy. A second file for each range lists its documents.

Texts are tokenized after the shuffle that orders them, a distinct word at a time: the pre-tokenizer of the vocabulary
never joins what white space separates, so a word's ids do not depend on its neighbours.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievery.llm.words import SPACED, blocks, release

END = 1
#: Token ids of a sequence, and sequences of a record batch.
SEQUENCE = 2048
BATCH = 256
#: Words whose ids a Python worker remembers.
REMEMBERED = 1_200_000

_coders: dict[str, WordCoder] = {}


def _differing(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the words of ``a`` aren't those of ``b``, byte by byte; no word is empty."""
    if not len(length):
        return np.zeros(0, bool)
    begin = np.cumsum(length) - length
    step = np.arange(int(begin[-1] + length[-1]))
    return np.logical_or.reduceat(a[np.repeat(a_start - begin, length) + step] != b[np.repeat(b_start - begin, length) + step], begin)


class WordCoder:
    """Ids of texts, word by word, from a tokenizer whose pre-tokenizer splits at white space.

    Words are known by hash, case and all, and by their bytes: one that shares only the hash of a known word is coded by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        """Known words by hash, ascending: where their bytes begin in ``text`` and their ids in ``flat``, and how many. The first of ``flat`` is the end id."""
        self.hashes, self.flat, self.text = np.zeros(0, np.uint64), np.zeros(1, self.type), np.zeros(0, np.uint8)
        self.begin, self.length, self.text_begin, self.text_length = (np.zeros(0, np.int64) for _ in range(4))

    def _coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has."""
        ids, counts = [np.zeros(0, self.type)], [np.zeros(0, np.int64)]
        for low in range(0, len(words), 4096):
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in words[low : low + 4096]], add_special_tokens=False)
            lists = [c.ids for c in coded]
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), self.type, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add words, in ascending order of their hashes."""
        ids, length = self._coded(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begin, self.length = np.insert(self.begin, at, len(self.flat) + np.cumsum(length) - length), np.insert(self.length, at, length)
        self.text_begin, self.text_length = np.insert(self.text_begin, at, len(self.text) + np.cumsum(size) - size), np.insert(self.text_length, at, size)
        self.flat = np.concatenate([self.flat, ids])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(words), np.uint8)])

    def _new(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes aren't known."""
        if not len(self.hashes):
            return np.arange(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.flatnonzero(self.hashes[at] != hashes)

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of blocks of texts, each text closed by ``end``, and how many each text has."""
        for block in blocks(column, SPACED, 1 << 21, fold=False):
            hashes, first, inverse = np.unique(block.hashes, return_index=True, return_inverse=True)
            new = self._new(hashes)
            if len(self.hashes) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(hashes))
            data = block.data.tobytes()
            words_at = lambda at: [data[a:b] for a, b in zip(block.start[at].tolist(), (block.start[at] + block.length[at]).tolist(), strict=True)]  # noqa: E731, B023
            if len(new):
                self._learn(hashes[new], words_at(first[new]))
            place = np.searchsorted(self.hashes, hashes)[inverse]
            begin, length, flat = self.begin[place], self.length[place], self.flat
            flat[0] = end
            alike = block.length == self.text_length[place]
            odd = ~alike
            odd[alike] = _differing(block.data, block.start[alike], self.text, self.text_begin[place[alike]], block.length[alike])
            if odd.any():
                ids, counts = self._coded(words_at(np.flatnonzero(odd)))
                begin[odd], length[odd] = len(flat) + np.cumsum(counts) - counts, counts
                flat = np.concatenate([flat, ids])
            # A text's end is one more word behind its own.
            of_word = np.insert(begin, block.first[1:], 0)
            n_of_word = np.insert(length, block.first[1:], 1)
            stop = np.cumsum(n_of_word)
            ids = flat[np.repeat(of_word - (stop - n_of_word), n_of_word) + np.arange(stop[-1])]
            ends = stop[block.first[1:] + np.arange(len(block.first) - 1)]
            yield ids, np.diff(np.concatenate([[0], ends]))


def _coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def _sequences(ids: np.ndarray, width: int) -> pa.RecordBatch:
    rows = -(-len(ids) // width)
    mask = np.arange(rows * width) < len(ids)
    padded = np.concatenate([ids, np.zeros(rows * width - len(ids), ids.dtype)])
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), width) for x in (padded, mask)], ["ids", "mask"])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part int, tokens string, docs string, n_tokens long"


def _writer(folder: str, tokenizer: str, end: int, width: int, rows: int, keep: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        total, held, n_held, sink = 0, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                schema = _sequences(np.zeros(0, coder.type), width).schema
                sink, listed = fs.open_output_stream(f"{base}/{name}.arrow"), fs.open_output_stream(f"{base}/{name}.docs.arrow")
                tokens, docs = pa.ipc.new_file(sink, schema), pa.ipc.new_file(listed, _DOCS)
            at = 0
            for ids, counts in coder.encode(batch.column(1), end):
                start = total + np.cumsum(counts) - counts
                docs.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), pa.array(start), pa.array(counts)], schema=_DOCS))
                at, total = at + len(counts), total + len(ids)
                held.append(ids)
                n_held += len(ids)
                if n_held >= width * rows:
                    joined = np.concatenate(held)
                    whole = len(joined) // (width * rows) * width * rows
                    for low in range(0, whole, width * rows):
                        tokens.write_batch(_sequences(joined[low : low + width * rows], width))
                    held, n_held = [joined[whole:].copy()], len(joined) - whole
        if sink is not None:
            if n_held:
                tokens.write_batch(_sequences(np.concatenate(held), width))
            for x in (tokens, docs, sink, listed):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": [f"{folder}/{name}.arrow"], "docs": [f"{folder}/{name}.docs.arrow"], "n_tokens": [total]})
        del coder
        if not keep:
            _coders.clear()
        release()

    return write


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, width: int = SEQUENCE, rows: int = BATCH, keep: bool = True) -> list[tuple[int, str, str, int, int]]:
    """Write ``docs`` (doc_id, text) to ``folder``; the files in order: part, token file, document file, ids, ids before.

    Null ids come first, equal ids in the order of their texts; a null text is an empty one and has only the end id. A
    task that is run again writes files of a new name, and only those that the list names count. The driver sees this
    list, which has a row for each partition. An empty table gives no files. Texts of any length are encoded whole, and other columns are
    dropped. ``keep``: workers keep the tokenizer and the words that they know for their next tasks, or else give that memory back.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows_in.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(tuple(r) for r in ordered.mapInArrow(_writer(folder, tokenizer, end, width, rows, keep), _MANIFEST).collect())
    listed, before = [], 0
    for file in files:
        listed.append((*file, before))
        before += file[3]
    return listed


class TokenFile:
    """Random access to a file's ids and masks, without a copy where the file can be mapped to memory."""

    def __init__(self, path: str):
        fs, name = pa.fs.FileSystem.from_uri(path)
        source = pa.memory_map(name) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(name)
        self.reader = pa.ipc.open_file(source)
        self.width = self.reader.schema.field("ids").type.list_size
        self.per_batch = len(self.reader.get_batch(0)) * self.width if self.reader.num_record_batches else 1
        self.at: tuple[int, np.ndarray | None] = (-1, None)

    def _batch(self, i: int) -> np.ndarray:
        if self.at[0] != i:
            self.at = (i, self.reader.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.at[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i and its mask."""
        batch, row = divmod(i * self.width, self.per_batch)
        got = self.reader.get_batch(batch)
        return got.column("ids")[row // self.width].values.to_numpy(), got.column("mask")[row // self.width].values.to_numpy(zero_copy_only=False)

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``start + n``, a view for each record batch that they touch."""
        while n > 0:
            batch, low = divmod(start, self.per_batch)
            piece = self._batch(batch)[low : low + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            tokens = TokenFile(file["tokens"])
            fs, name = pa.fs.FileSystem.from_uri(file["docs"])
            with fs.open_input_file(name) as source:
                reader = pa.ipc.open_file(source)
                for i in range(reader.num_record_batches):
                    docs, sums = reader.get_batch(i), []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for piece in tokens.pieces(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    start = pa.array(docs.column("start").to_numpy() + file["before"])
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, files: list[tuple[int, str, str, int, int]]) -> DataFrame:
    """doc_id, start (in the whole stream), n_tokens and ids_crc32 of the documents in ``files``, from the files."""
    listed = spark.createDataFrame(files, "part int, tokens string, docs string, n_tokens long, before long")
    dealt = listed.repartition(max(1, min(len(files), int(spark.conf.get("spark.sql.shuffle.partitions")))), "part")
    return dealt.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
