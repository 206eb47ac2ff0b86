"""Hashed maximum-entropy language model with a class-factored softmax (operator 4).

P(token | context) = P(class | context) * P(token | class, context). The class comes from a softmax whose weights sit in
hashed rows: the previous word (bigram), the two previous words (trigram), the word before the previous one
(skip) and the pair of their classes. P(token | class, context) goes down a binary tree of the class's words, by the
bits of the word's hash: the logit of each turn is that of the counts below, plus hashed weights of (turn, bigram),
(turn, trigram) and (turn, skip). Words of one leaf share it by their smoothed counts.

Classes: the most frequent words and the end token are classes of their own; all other words fall into clusters
of word endings, found by k-means over the distribution of what precedes an ending (a table of fixed size).
Training is one pass over all training documents in two rounds or more: each shard runs Adagrad updates over its
documents from the common weights, and the shards' weights are averaged row by row, weighted by visits. Rows, the
word weights and rounds grow with the training tokens (see sizes).

Counts cover all training documents. Words with at least a share SHARE of all tokens (so at most 1/SHARE of
them) are broadcast; the other tokens meet their counts in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import VECTOR_SCHEMA, Tables, documents, materialize, sum_vectors, vector_rows
from mixtide.llm._text import Words, mix, words

SHARE = 5e-7
SINGLES, CLUSTERS = 8, 24
CLASSES = SINGLES + CLUSTERS
ENDINGS, BEFORE = 4096, 256
#: Rows to each kind of context and weights of the word factor, at least (those at GROWTH_TOKENS: WORD_SLOTS).
ROWS = 8192
LEAST_SLOTS, WORD_SLOTS = 1 << 16, 1 << 20
GROWTH_TOKENS = 64_000_000
#: Levels of the word trees, at most; there is a leaf in four for each word of the head.
MOST_DEPTH = 14
#: Training tokens to a shard of training, at least; bounds what the shards send against what they read.
SHARD_TOKENS = 4_000_000
BATCH = 4096
END = np.uint64(0x9B97F4A7C15E3779)
_START = np.uint64(0x51A3C0DE00000001)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def sizes(total: int) -> tuple[int, int, int, int]:
    """(rows, word weights, rounds, shards to a round) for so many training tokens.

    Tables grow with the root of the tokens beyond GROWTH_TOKENS (word weights in proportion before that), and shards
    grow with the tables, so that what shards send stays in proportion to what they read.
    """
    growth = total / GROWTH_TOKENS
    grown = round(np.log2(max(growth, 1)) / 2)
    slots = WORD_SLOTS << grown if growth >= 1 else max(LEAST_SLOTS, WORD_SLOTS >> int(-np.log2(max(growth, 1e-9))))
    rows, rounds = ROWS << grown, 2 + grown // 2
    floats = (3 * rows + CLASSES * CLASSES) * (CLASSES + 1) + 2 * slots
    return rows, slots, rounds, max(1, round(2 * total / (rounds * max(SHARD_TOKENS, 1.5 * floats))))


def endings(w: Words) -> np.ndarray:
    """The hashed last three letters' bytes of each word (of a word without letters: its last three bytes)."""
    at = np.where(_LETTER[w.data], np.arange(len(w.data)), -1)
    last = np.maximum.accumulate(at)[w.end - 1] if len(at) else np.zeros(0, np.int64)
    last = np.where(last >= w.start, last, w.end - 1)
    out = w.data[last].astype(np.uint64)
    for back in (1, 2):
        out = out * np.uint64(257) + np.where(last - back >= w.start, w.data[np.maximum(last - back, 0)], 0).astype(np.uint64)
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings of the words with an end token after each document, and the documents' bounds."""
    return np.insert(w.hash, w.bounds[1:], END), np.insert(endings(w), w.bounds[1:], ENDINGS), w.bounds + np.arange(len(w.bounds))


def _tally(kind: int, keys: list[np.ndarray], extra: list[np.ndarray] | None, n: list[np.ndarray] | None = None) -> tuple:
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.add.reduceat(np.concatenate(n)[order], starts) if n is not None and len(starts) else np.diff(np.append(starts, len(key)))
    return key[starts], (np.concatenate(extra)[order][starts] if extra is not None else np.full(len(starts), kind)), counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(kind, key, end, n):
        for k in range(0, len(key), 200_000):
            s = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[s]), kind, np.int32)), pa.array(key[s].view(np.int64)), pa.array(end[s].astype(np.int32)), pa.array(n[s].astype(np.int64))], names=["kind", "key", "ending", "n"])

    held: list[tuple] = []
    pairs = np.zeros(BEFORE * (ENDINGS + 1), dtype=np.int64)
    for batch in batches:
        parts, met = [], []
        for w in words(batch.column("text")):
            h, e, bounds = tokens(w)
            before = np.concatenate([[ENDINGS], e[:-1]]) % BEFORE
            parts.append(_tally(0, [h], [e]))
            met.append(before * (ENDINGS + 1) + e)
        if parts:
            pairs += np.bincount(np.concatenate(met), minlength=len(pairs))
            held.append(_tally(0, [x[0] for x in parts], [x[1] for x in parts], [x[2] for x in parts]))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held = [_tally(0, *([y[k] for y in held] for k in (0, 1, 2)))]
                if len(held[0][0]) > 1_000_000:  # a partition of any size stays within this memory
                    yield from rows(0, *held.pop())
    if held:
        yield from rows(0, *_tally(0, *([y[k] for y in held] for k in (0, 1, 2))))
    at = np.flatnonzero(pairs)
    yield from rows(1, at.astype(np.uint64), np.zeros(len(at)), pairs[at])


def cluster(met: np.ndarray, k: int = CLUSTERS, rounds: int = 8) -> np.ndarray:
    """A cluster for each ending, by weighted k-means over square roots of the shares of what precedes it."""
    weight = met.sum(axis=0)
    x = np.sqrt(met / np.maximum(weight, 1)).T
    centre = x[[int(np.argmax(weight))]]
    gap = ((x - centre[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        new = x[int(np.argmax(gap * np.sqrt(weight)))]
        centre = np.vstack([centre, new])
        gap = np.minimum(gap, ((x - new) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
        for c in range(k):
            if (total := weight[own == c].sum()) > 0:
                centre[c] = (x[own == c] * weight[own == c, None]).sum(axis=0) / total
    return own


def word_tree(mass: np.ndarray) -> np.ndarray:
    """Logits of turning right at nodes 1, 2, ... of each class's tree, from the masses of its leaves (classes, leaves)."""
    out, depth = np.zeros(mass.shape, dtype=np.float32), mass.shape[1].bit_length() - 1
    for level in range(depth - 1, -1, -1):
        left, right = mass[:, 0::2], mass[:, 1::2]
        out[:, 1 << level : 2 << level] = np.log(right / left)
        mass = left + right
    return out


def log_sigmoid(z: np.ndarray) -> np.ndarray:
    return np.minimum(z, 0) - np.log(1 + np.exp(-np.abs(z)))


def _halve(op: np.ufunc, z: np.ndarray) -> np.ndarray:
    """op.reduce over the classes (a power of two), by halves: the same for a row wherever it stands."""
    while z.shape[1] > 1:
        z = op(z[:, : z.shape[1] // 2], z[:, z.shape[1] // 2 :])
    return z


class Model:
    """Classes, counts of frequent words and weights: what scoring needs on every executor."""

    def __init__(self, classes, singles, single_class, head, head_n, log_total, base_total, rows, tree, slots):
        self.classes, self.singles, self.single_class = classes, singles, single_class
        self.head, self.head_n, self.log_total, self.base_total = head, head_n, log_total, base_total
        self.rows, self.table = rows, 3 * rows + CLASSES * CLASSES
        self.weights = np.zeros((self.table, CLASSES), dtype=np.float32)
        self.tree, self.depth = tree, tree.shape[1].bit_length() - 1  # logit of the counts at each turn, by class
        self.slots, self.word_weights = slots, np.zeros(slots, dtype=np.float32)

    def class_of(self, h: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = self.classes[e]
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, h), len(self.singles) - 1)
            hit = self.singles[at] == h
            out = np.where(hit, self.single_class[at], out)
        return out

    def features(self, h: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the weight table for each token, (4, tokens), and its contexts' hashes, (3, tokens)."""
        begin = bounds[:-1]
        h1, c1 = np.concatenate([[_START], h[:-1]]), np.concatenate([[0], c[:-1]])
        h1[begin], c1[begin] = _START, 0
        h2, c2 = np.concatenate([[_START], h1[:-1]]), np.concatenate([[0], c1[:-1]])
        h2[begin], c2[begin] = _START, 0
        pair = (h1 * np.uint64(0x9E3779B97F4A7C15) + h2) * np.uint64(0xD6E8FEB86659FD93)
        low = np.uint64(self.rows - 1)
        out = np.empty((4, len(h)), dtype=np.int32)
        out[0] = h1 & low
        out[1] = self.rows + (pair >> np.uint64(64 - (self.rows.bit_length() - 1))).astype(np.int32)
        out[2] = 2 * self.rows + ((h2 >> np.uint64(20)) & low).astype(np.int32)
        out[3] = 3 * self.rows + c1 * CLASSES + c2
        return out, np.stack([mix(h1), mix(pair), mix(h2 + np.uint64(0xA0761D6478BD642F))])

    def turns(self, h: np.ndarray, c: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of clusters: places of their weights (tokens, depth, 3), logits of the counts and signs (tokens, depth)."""
        bucket = (h >> np.uint64(64 - self.depth)).astype(np.int64)
        level = np.arange(self.depth)[:, None]  # computed with the tokens last, where numpy's loops are long
        name = (c << self.depth) | (1 << level) | (bucket >> (self.depth - level))
        sign = (2 * ((bucket >> (self.depth - 1 - level)) & 1) - 1).astype(np.float32)
        at = contexts[:, None, :] ^ (name.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at *= np.uint64(0x9E3779B97F4A7C15)
        at >>= np.uint64(64 - (self.slots.bit_length() - 1))
        return at.view(np.int64).T, self.tree.ravel().take(name).T, sign.T

    def forward(self, f: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = weights.take(f[0], axis=0)
        for k in (1, 2, 3):
            z += weights.take(f[k], axis=0)
        z -= _halve(np.maximum, z)
        return z

    def gain(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Summed weights of the three contexts at each turn, (tokens, depth)."""
        x = weights.take(at.T[0])
        x += weights.take(at.T[1])
        x += weights.take(at.T[2])
        return x.T


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at starts, from running sums in double precision."""
    total = np.cumsum(rows, axis=0, dtype=np.float64)
    ends = total.take(np.append(starts[1:], len(rows)) - 1, axis=0)
    ends[1:] -= ends[:-1].copy()
    return ends.astype(np.float32)


def _train(shared, rate: float):
    """Updated weights of each shard; a shard's rows come one after the other, and each starts from the common weights."""

    def one(columns: Iterator[pa.Array], shard: int) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        w, seen = model.weights.copy(), np.zeros(model.table, dtype=np.float32)
        gain = np.full((model.table, CLASSES), 1e-2, dtype=np.float32)
        v, met = model.word_weights.copy(), np.zeros(model.slots, dtype=np.float32)
        word_gain, step_of = np.full(model.slots, 1e-2, dtype=np.float32), np.zeros(model.slots, dtype=np.float32)
        narrow = np.uint16 if model.table <= 1 << 16 else np.uint32
        for texts in columns:
            for part in words(texts):
                h, e, bounds = tokens(part)
                c = model.class_of(h, e)
                f, contexts = model.features(h, c, bounds)
                for a in range(0, len(h), BATCH):
                    fa, ca = f[:, a : a + BATCH], c[a : a + BATCH]
                    g = np.exp(model.forward(fa, w))
                    g /= _halve(np.add, g)
                    g[np.arange(len(ca)), ca] -= 1
                    for k in range(4):
                        order = np.argsort(fa[k].astype(narrow), kind="stable")
                        rows = fa[k][order]
                        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                        step, rows_at = _sums(g.take(order, axis=0), starts), rows[starts]
                        gained = gain.take(rows_at, axis=0)
                        gained += step * step
                        gain[rows_at] = gained
                        w[rows_at] -= rate * step / np.sqrt(gained)
                        seen[rows_at] += np.diff(np.append(starts, len(rows)))
                    own = np.flatnonzero(ca >= SINGLES)
                    at, prior, sign = model.turns(h[a : a + BATCH][own], ca[own], contexts[:, a : a + BATCH][:, own])
                    slope = -sign / (1 + np.exp(np.clip(sign * (prior + model.gain(at, v)), -50, 50)))
                    at = at.T.ravel()
                    np.add.at(step_of, at, np.tile(slope.T.ravel(), 3))
                    step = step_of.take(at)  # equal at equal places, so that assignments agree
                    step_of[at] = 0
                    gained = word_gain.take(at)
                    gained += step * step
                    word_gain[at] = gained
                    v[at] = v.take(at) - rate * step / np.sqrt(gained)
                    np.add.at(met, at, np.float32(1))
        yield from vector_rows({"short_w": w * seen[:, None], "short_n": seen, "short_v": v * met, "short_m": met}, shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = ((shard, batch.column("text").slice(at, size)) for batch in batches for shard, at, size in _runs(batch.column("shard").to_numpy()))
        for shard, group in groupby(runs, key=lambda x: x[0]):
            yield from one((texts for _, texts in group), int(shard))

    return run


def _runs(shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first row, rows) of runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, np.int64)
    return [(int(shards[a]), int(a), int(n)) for a, n in zip(at, np.diff(np.append(at, len(shards))), strict=True)]


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, part double, logs double, known long, rare array<long>, times array<int>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for part in words(batch.column("text")):
                h, e, bounds = tokens(part)
                c = model.class_of(h, e)
                f, contexts = model.features(h, c, bounds)
                term = np.empty(len(h))
                for a in range(0, len(h), BATCH):
                    z = model.forward(f[:, a : a + BATCH], model.weights)
                    own = z[np.arange(len(z)), c[a : a + BATCH]]
                    term[a : a + BATCH] = (own - np.log(_halve(np.add, np.exp(z, out=z))[:, 0])) / np.log(10.0)
                    own = np.flatnonzero(c[a : a + BATCH] >= SINGLES) + a
                    at, prior, sign = model.turns(h[own], c[own], contexts[:, own])
                    gained = log_sigmoid(sign * (prior + model.gain(at, model.word_weights))) - log_sigmoid(sign * prior)
                    term[own] += gained.sum(axis=1, dtype=np.float64) / np.log(10.0)
                term -= model.log_total[c]
                logs = np.zeros(len(h))
                if len(model.head):
                    at = np.minimum(np.searchsorted(model.head, h), len(model.head) - 1)
                    hit = model.head[at] == h
                    logs[hit] = np.log10(model.head_n[at[hit]] + 0.1)
                else:
                    hit = np.zeros(len(h), dtype=bool)
                doc = np.repeat(np.arange(part.n_docs), np.diff(bounds))
                # distinct rare tokens of each document, with their times
                rare = np.flatnonzero(~hit)
                order = np.lexsort((h[rare], doc[rare]))
                rh, rd = h[rare][order], doc[rare][order]
                starts = np.flatnonzero(np.concatenate([[True], (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])])) if len(rh) else np.zeros(0, np.int64)
                lists = pa.array(np.searchsorted(rd[starts], np.arange(part.n_docs + 1)), pa.int32())
                s = slice(part.first, part.first + part.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(part.n_docs)),
                        batch.column("doc_id")[s].cast(pa.int64()),
                        batch.column("held_out")[s],
                        pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat(term, bounds[:-1])),
                        pa.array(np.add.reduceat(logs, bounds[:-1])),
                        pa.array(np.add.reduceat(hit.astype(np.int64), bounds[:-1])),
                        pa.ListArray.from_arrays(lists, pa.array(rh[starts].view(np.int64))),
                        pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(starts, len(rh))).astype(np.int32))),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "part", "logs", "known", "rare", "times"],
                )
                row += part.n_docs

    return run


def score_documents(docs: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    held_out: a Column; rows where it is true are scored but not learned from (default: crc32 of the doc_id as
    text is divisible by 10; a null doc_id counts as 0). Null text is empty: its one token is the end. Without
    any training row both scores come from uniform counts. Equal rows have equal scores, and the scores are the same
    whatever the input's partitions. An empty table gives no rows. Other columns are ignored.
    """
    with Tables(docs.sparkSession) as tables:
        return materialize(_score_documents(docs, held_out, tables), "scores")


def _score_documents(docs: DataFrame, held_out, tables: Tables) -> DataFrame:
    spark = docs.sparkSession
    out = F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out if held_out is not None else out % 10 == 0, F.lit(False)).alias("held_out"), out.alias("__crc"))
    train = named.filter(~F.col("held_out"))

    tallies = train.select("text").mapInArrow(_count, "kind int, key long, ending int, n long")
    tallies = tables.write(tallies.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")), "tallies")
    vocabulary = tallies.filter("kind = 0")
    met = np.zeros(BEFORE * (ENDINGS + 1))
    cells = tallies.filter("kind = 1").select("key", "n").toPandas()  # at most BEFORE * ENDINGS cells
    met[cells["key"].to_numpy()] = cells["n"]
    by_ending = vocabulary.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    total, distinct = int(by_ending["n"].sum()), int(by_ending["v"].sum())
    floor = max(2.0, total * SHARE)
    head = vocabulary.filter(F.col("n") >= floor).select("key", "n", "ending").toPandas()  # at most 1 / SHARE words
    hashes, counts = head["key"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)

    classes = np.full(ENDINGS + 1, 0)
    classes[:ENDINGS] = SINGLES + cluster(met.reshape(BEFORE, ENDINGS + 1)[:, :ENDINGS])
    top = np.lexsort((hashes, -counts))
    top = top[hashes[top] != END][: SINGLES - 1]
    depth = int(np.clip(np.ceil(np.log2(4 * max(len(hashes), 1) / CLUSTERS)), 4, MOST_DEPTH))
    rows, slots, rounds, shards = sizes(total)
    own = F.broadcast(spark.createDataFrame([(k, int(c)) for k, c in enumerate(classes)], "ending int, class int"))
    leaves = vocabulary.join(own, "ending").groupBy("class", F.shiftrightunsigned("key", 64 - depth).cast("int").alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # at most CLUSTERS << depth leaves
    leaf_n, leaf_v = np.zeros((CLASSES, 1 << depth)), np.zeros((CLASSES, 1 << depth))
    at = leaves["class"].to_numpy(np.int64), leaves["leaf"].to_numpy(np.int64)
    leaf_n[at], leaf_v[at] = leaves["n"], leaves["v"]
    single_n = np.zeros(SINGLES)
    single_n[0] = leaf_n[0].sum()
    for k, i in enumerate(top):
        old = classes[head["ending"].to_numpy()[i]], int(hashes[i] >> np.uint64(64 - depth))
        leaf_n[old] -= counts[i]
        leaf_v[old] -= 1
        single_n[k + 1] = counts[i]
    mass = leaf_n + 0.1 * (leaf_v + 1)  # each leaf has room for words not met
    log_total = np.log10(mass.sum(axis=1))
    log_total[:SINGLES] = np.log10(single_n + 0.1)  # a class of one token: its share is 1
    by_hash = np.argsort(hashes)
    singles = np.argsort(hashes[top])
    model = Model(classes, hashes[top][singles], (singles + 1).astype(np.int64), hashes[by_hash], counts[by_hash], log_total, np.log10(total + 0.1 * (distinct + 1)), rows, word_tree(mass), slots)

    for part in range(rounds):
        rate = 0.25 if part == 0 else 0.24 / (part + 1)
        shared = spark.sparkContext.broadcast(model)
        # shards by hash, in order inside: what is learned does not depend on the partitions of the input
        own = train.filter(F.floor(F.col("__crc") / 10) % rounds == part).select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
        own = own.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text").select("shard", "text")
        sums = sum_vectors(own.mapInArrow(_train(shared, rate), VECTOR_SCHEMA), {"short_w": model.table * CLASSES, "short_n": model.table, "short_v": slots, "short_m": slots})
        if sums:
            n = sums["short_n"][:, None]
            model.weights = np.where(n > 0, sums["short_w"].reshape(model.table, CLASSES) / np.maximum(n, 1), model.weights).astype(np.float32)
        if "short_m" in sums:
            m = sums["short_m"]
            model.word_weights = np.where(m > 0, sums.get("short_v", np.zeros(slots)) / np.maximum(m, 1), model.word_weights).astype(np.float32)
        shared.unpersist()

    shared = spark.sparkContext.broadcast(model)
    scored = tables.write(named.select("doc_id", "text", "held_out").mapInArrow(_score(shared), _SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    rest = vocabulary.filter(F.col("n") < floor).select("key", "n")
    met_rare = rare.join(rest, "key", "left").select("row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("part"))
    added = met_rare.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("part").alias("more"))
    both = scored.drop("rare", "times").join(added, "row", "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(model.base_total))).alias("base_score"),
        (logs + F.col("part")).alias("score"),
    )


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents; nulls and repeats as in score_documents."""
    return score_documents(documents(spark, sf_dir))
