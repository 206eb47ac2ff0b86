"""Packing by concatenate and cut (operator 7).

Pass one turns each document into token ids once, writes them with their place inside the partition, and
gives every partition's total. A prefix sum over those totals gives global offsets; pass two cuts each document
at the multiples of the window and returns the boundary records, one per piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import documents, new_path
from mixtide.llm._text import words

WINDOW = 2048
END_ID = 1
_SLOTS = 1 << 21
_MOST_IDS = 24_000_000
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Encoder:
    """Token ids of whole columns. Ids of words are kept in a direct-mapped table, so each is mostly encoded once.

    A chunk between white space is encoded as its front and its trailing ASCII punctuation where the front ends in
    a letter or digit, which the tokenizer keeps apart as well. A document with the text of a special token is
    encoded in one go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.key, self.start, self.size = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.flat, self.used = np.full(1 << 20, END_ID, dtype=self.type), 1

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts are encoded in batches joined by the mark; one that may hold a mark is encoded alone."""
        out: list[np.ndarray] = [np.zeros(0, self.type)] * len(texts)
        alone = [i for i, x in enumerate(texts) if "<|" in x]
        for i in alone:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=self.type)
        held = set(alone)
        joined = [i for i in range(len(texts)) if i not in held]
        for k in range(0, len(joined), 4000):
            some = joined[k : k + 4000]
            ids = np.array(self.tokenizer.encode(self.mark.join([texts[i] for i in some]), add_special_tokens=False).ids, dtype=self.type)
            pieces = np.split(ids, np.flatnonzero(ids == self.mark_id))
            for i, x in zip(some, [pieces[0], *(x[1:] for x in pieces[1:])], strict=True):
                out[i] = x
        return out

    def _look_up(self, h: np.ndarray, w, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        start, size = self.start[slot], self.size[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            data = w.data
            ids = self._encode([data[a:b].tobytes().decode() for a, b in zip(begin[miss[first]], end[miss[first]], strict=True)])
            sizes = np.array([len(x) for x in ids], dtype=np.int32)
            total = int(sizes.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = np.concatenate(ids) if total else 0
            starts = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
            self.used += total
            start[miss], size[miss] = starts[back], sizes[back]
            at = (new & np.uint64(_SLOTS - 1)).astype(np.int64)
            self.key[at], self.start[at], self.size[at] = new, starts, sizes
        return start, size

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, ids, bounds) of blocks of documents; every document ends in END_ID."""
        for w in words(column):
            if self.used > _MOST_IDS:
                self.clear()
            last = np.maximum.accumulate(np.where(_PUNCTUATION[w.data], -1, np.arange(len(w.data)))) if len(w.data) else np.zeros(0, np.int64)
            cut = np.maximum(last[w.end - 1] + 1, w.start)
            tail = w.data[np.maximum(cut - 1, 0)]
            ahead = w.data[np.maximum(cut - 2, 0)]
            plain = ((tail >= 97) & (tail <= 122)) | ((tail >= 48) & (tail <= 57)) | ((ahead == 0xC3) & (cut - 2 >= w.start) & (tail != 0x97) & (tail != 0xB7))
            cut = np.where(plain | (cut == w.start), cut, w.end)
            begin, end = np.stack([w.start, cut], axis=1).ravel(), np.stack([cut, w.end], axis=1).ravel()
            keep = end > begin
            per_doc = np.concatenate([[0], np.cumsum(keep)])[2 * w.bounds]
            begin, end = begin[keep], end[keep]
            start, size = self._look_up(w.part_hash(begin, end), w, begin, end)
            start, size = np.insert(start, per_doc[1:], 0), np.insert(size, per_doc[1:], 1)
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(total)]
            bounds = np.concatenate([[0], ends])[per_doc + np.arange(len(per_doc))]
            special = np.flatnonzero((w.data[:-1] == 60) & (w.data[1:] == 124))
            if len(special):
                parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for i in range(w.n_docs):
                    if w.bounds[i + 1] > w.bounds[i] and ((special >= w.start[w.bounds[i]]) & (special < w.end[w.bounds[i + 1] - 1])).any():
                        text = column[w.first + i].as_py()
                        parts[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], dtype=self.type)
                ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            yield w.first, ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        context = TaskContext.get()
        part, before = context.partitionId() if context else 0, 0
        for batch in batches:
            for first, ids, bounds in coder.encode(batch.column("text")):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(before + bounds[:-1]),
                        batch.column("doc_id").slice(first, n).cast(pa.int64()),
                        pa.array(np.diff(bounds)),
                        pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    ],
                    names=["part", "before", "doc_id", "doc_tokens", "ids"],
                )
                before += int(bounds[-1])

    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(offsets: dict[int, int], window: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for part, before, doc_id, n, raw in zip(*(batch.column(c) for c in ("part", "before", "doc_id", "doc_tokens", "ids")), strict=True):
                at, n, ids = offsets[part.as_py()] + before.as_py(), n.as_py(), np.frombuffer(raw.as_buffer(), dtype=kind)
                start = 0
                while start < n:
                    length = min(n - start, window - (at + start) % window)
                    rows.append((doc_id.as_py(), start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), n, (at + start) // window, (at + start) % window))
                    start += length
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow one another in the order of the input's partitions; all sequences are full but the last.
    Null or empty text: one piece with the end id alone. Null doc_id: pieces with a null doc_id. An empty table
    has no pieces. Repeated rows are packed each on their own. Other columns are ignored.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = new_path(spark, "ids")
    schema = "part int, before long, doc_id long, doc_tokens long, ids binary"
    named.mapInArrow(_ids(path), schema).write.option("compression", "zstd").parquet(place)
    table = spark.read.schema(schema).parquet(place)
    offsets, total = {}, 0
    for r in table.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect():  # one row per partition
        offsets[r["part"]] = total
        total += r["n"]
    return table.mapInArrow(_cut(offsets, window, np.dtype(encoder(path).type).str), _PIECE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
