"""Periodic runs of words by string synchronising sets (operator 12).

A run is a stretch of words with smallest period q, of at least 2 * q words, that cannot be extended. Periods
3t - 1 .. 6t - 2 are found at scale t = 1, 2, 4, ...: positions are selected by hashes of t words, so that equal contexts of 2t
words are selected alike and every t consecutive positions hold one, unless 3t - 1 words there have a period of t / 3
or less. A run of period q at least 3t - 1 is longer than its period by t such positions and their contexts: one of
them is selected, and so is the equal context q words on. Pairs of equal contexts propose their distance, and the run
around them is measured. Regions of small period select nothing; they are known from the scales before. A run whose first
period lies in such a region, but not the whole run, goes over the end of that region, where a second one of the same
small period begins: each two regions that meet so propose the distances at which they agree.

Many documents are handled as one array, with a value of its own between any two. All comparisons are of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.functions.math import bind
from mixtide.llm._common import WORD, documents
from mixtide.llm._text import Words, _power, mix, words

LEAST = 12
BLOCK = 4 << 20
_NEVER = np.uint64(2**64 - 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Array:
    """A sequence of 64-bit values with hashes of its stretches."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        up, self.down = _power(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(mix(x) * up[: self.n], out=self.sums[1:])

    def stretch(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def all_stretches(self, length: int) -> np.ndarray:
        m = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:m]) * self.down[:m])

    def common(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many values from i < j on (or in front of them, backwards) are the same, by halving steps."""
        got = np.zeros(len(i), dtype=np.int64)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            a, b = (i - got - step, j - got - step) if back else (i + got, j + got)
            fits = np.flatnonzero(a >= 0 if back else b + step <= self.n)
            same = self.stretch(a[fits], step) == self.stretch(b[fits], step)
            got[fits[same]] += step
            step >>= 1
        return got


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of (start, end, period) rows each stretch once, with its smallest period, by start and end."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _measured(a: _Array, at: np.ndarray, period: np.ndarray, reach: int) -> np.ndarray:
    """The runs around (at, at + period); of proposals of a period within reach of each other, the first speaks for all."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] > reach)
    at, period = at[first], period[first]
    start = at - a.common(at, at + period, back=True)
    end = at + period + a.common(at, at + period, back=False)
    long = end - start >= 2 * period
    return np.stack([start[long], end[long], period[long]], axis=1)


def _pairs(a: _Array, scale: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions with equal contexts at distances 3 * scale - 1 .. 6 * scale - 2: (position, distance)."""
    names = a.all_stretches(scale)
    small = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    if len(small):
        cover = np.bincount(small[:, 0], minlength=len(names) + 1) - np.bincount(small[:, 1] - scale + 1, minlength=len(names) + 1)
        names[np.cumsum(cover)[: len(names)] > 0] = _NEVER
    low, wide = names, 1
    while wide < scale:
        low, wide = np.minimum(low[:-wide], low[wide:]), 2 * wide
    count = a.n - 2 * scale + 1
    low = np.minimum(low[:count], names[scale : scale + count])
    at = np.flatnonzero(((low == names[:count]) | (low == names[scale : scale + count])) & (low != _NEVER))
    context = a.stretch(at, 2 * scale)
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    found, ahead = [], 1
    while ahead < len(at):  # equal contexts lie over scale / 3 apart, so this ends after 18 turns
        gap = at[ahead:] - at[:-ahead]
        near = (context[ahead:] == context[:-ahead]) & (gap < 6 * scale - 1)
        if not near.any():
            break
        near &= gap >= 3 * scale - 1
        found.append((at[:-ahead][near], gap[near]))
        ahead += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _seams(a: _Array, scale: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions of one small period that meet propose the distances at which they agree, from the end of the first."""
    regions = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= 3 * scale - 1)]
    regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    at, period = [], []
    meet = (regions[1:, 2] == regions[:-1, 2]) & (regions[1:, 0] <= regions[:-1, 1])
    for (s, e, p), (s2, e2, _) in zip(regions[:-1][meet], regions[1:][meet], strict=True):
        shift = np.flatnonzero(a.stretch(s2 + np.arange(p), p) == a.stretch(np.array([s]), p))
        least, most = 3 * scale - 1, min(6 * scale - 2, e - s, e2 - s2)
        if len(shift) and e < a.n:
            q = np.arange(least + (s2 + shift[0] - s - least) % p, most + 1, p)
            at.append(e - q)
            period.append(q)
    return (np.concatenate(at), np.concatenate(period)) if at else (np.zeros(0, np.int64),) * 2


def runs_of(x: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs of two periods or more in x, whose runs have at most longest values."""
    a = _Array(x)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], x[1:] == x[:-1], [False]]).astype(np.int8)))
    runs = np.stack([edge[::2], edge[1::2] + 1, np.ones(len(edge) // 2, np.int64)], axis=1)
    scale = 1
    while 6 * scale - 2 <= longest:
        met, seams = _pairs(a, scale, runs), _seams(a, scale, runs)
        new = [_measured(a, *met, 2 * scale), _measured(a, *seams, 0)]
        runs = _smallest(np.concatenate([runs, *new]))
        scale *= 2
    return runs


def document_runs(w: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Runs of least words or more of the documents of w: their documents' numbers, and (start, length, period) rows.

    Documents are taken together by size, the next class from twice the words on: each class has its own number of scales.
    """
    count = np.diff(w.bounds)
    owners, found = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    size = max(least, 2)
    while size <= count.max(initial=0):
        docs = np.flatnonzero((count >= size) & (count < 2 * size))
        size *= 2
        if not len(docs):
            continue
        lengths = count[docs] + 1  # a value of its own behind each document
        begin = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.arange(begin[-1]) - np.repeat(begin[:-1], lengths)
        last = inside == np.repeat(count[docs], lengths)
        source = np.where(last, 0, np.repeat(w.bounds[docs], lengths) + inside)
        x = np.where(last, mix(np.arange(begin[-1], dtype=np.uint64) ^ np.uint64(0x5BF03635F0A31D4B)), w.hash[source])
        runs = runs_of(x, int(count[docs].max()))
        runs = runs[runs[:, 1] - runs[:, 0] >= least]
        place = np.searchsorted(begin, runs[:, 0], side="right") - 1
        owners.append(docs[place])
        found.append(np.stack([runs[:, 0] - begin[place], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1))
    owner, rows = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    return owner[order], rows[order]


def _joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    docs = np.repeat(np.arange(w.n_docs), np.diff(w.bounds))[keep]
    start, size = w.start[keep], (w.end - w.start)[keep]
    first = np.ones(len(docs), dtype=bool)
    first[1:] = docs[1:] != docs[:-1]
    wide = size + ~first  # a space in front of all but a document's first word
    begin = np.concatenate([[0], np.cumsum(wide)])
    source = np.arange(begin[-1]) - np.repeat(begin[1:] - size - start, wide)
    out = w.data[np.maximum(source, 0)] if len(source) else np.zeros(0, np.uint8)
    out[begin[:-1][~first]] = 32
    at = begin[np.searchsorted(docs, np.arange(w.n_docs + 1))]
    return pa.LargeStringArray.from_buffers(w.n_docs, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _found(columns: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), BLOCK, lower=False):
                owner, rows = document_runs(w, least)
                drop = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(drop, w.bounds[owner] + rows[:, 0] + rows[:, 2], 1)
                np.add.at(drop, w.bounds[owner] + rows[:, 0] + rows[:, 1], -1)
                structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(w.n_docs + 1)), pa.int32()), structs)
                part = batch.slice(w.first, w.n_docs)
                values = [*(part.column(c) for c in columns), lists, _joined(w, np.cumsum(drop[:-1]) == 0)]
                yield pa.RecordBatch.from_arrays(values, names=[*columns, "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with runs, the runs of at least `least` words as (start, length, period), and collapsed, their texts without repeats.

    Words are told apart by case; runs go by start, then period; collapsed keeps the words of each run's first period and
    those outside all runs, joined by one space. Null, empty and wordless texts have no runs and an empty collapsed.
    Rows are judged each on their own, whole, of any length; an empty table stays empty; columns runs and collapsed are replaced.
    """
    kept = [k for k, c in enumerate(docs.columns) if c not in ("runs", "collapsed")]
    names = [f"c{k}" for k in kept]
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).select(*names, F.col(f"c{docs.columns.index('text')}").cast("string").alias("text"))
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c != "text"), f"runs {RUNS}", "collapsed string"])
    return rows.mapInArrow(_found(names, least), schema).toDF(*(docs.columns[k] for k in kept), "runs", "collapsed")


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, or of one document in ten by crc32 of its doc_id, its words with a repeating tail; null doc_ids stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    word = F.filter(F.split(text, WORD.replace("[^", "[", 1)), lambda x: x != "")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    return F.when(F.pmod(h, F.lit(10)) == 0, bind(word, repeat)).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten with a repeated tail; null texts have no words."""
    docs = documents(spark, sf_dir).select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("best.back")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
