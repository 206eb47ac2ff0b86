"""Grouping of spelling variants by a trie over letter-group counts (operator 13).

A word's vector has the counts of its letters in GROUPS groups; one inserted, deleted or replaced letter moves it by at
most one surplus and one deficit. The trie arranges words by successive counts, the most telling group first. Nodes
with more than a cell's words branch, the others are cells; a word goes to its own cell and, as a probe, to those that
the two budgets reach. Inside a cell the search goes on, probes against words, down to the last group. Leaf words that
share the half of the letters which one edit must leave alone are compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import Tables, documents, materialize
from mixtide.llm._text import _LOWER, _power, blocks, mix, string_buffers

GROUPS = 16
LEAST_LETTERS, LEAST_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
#: A node of the trie with more words than the larger of CELL and a CELLS-th of all words branches: at most CELLS of a depth.
CELL, CELLS = 4096, 1024
BLOCK = 4 << 20
#: Probe vectors that descend together, and letters that are compared together.
TOGETHER, LETTERS = 8192, 1 << 22

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[start : start + size] behind what has the crc32 before."""
    order = np.argsort(-size, kind="stable")
    at, left, c = start[order], size[order], before[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(min(64, int(left[0]) if len(left) else 0)):
        n = int(np.searchsorted(-left, -k, side="left"))
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-left, -64, side="left"))):  # longer ones
        c[k] = zlib.crc32(data[at[k] + 64 : at[k] + left[k]].tobytes(), int(c[k]))
    out = np.empty_like(c)
    out[order] = c
    return out


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of data one after the other, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)], bounds


def _damaged(word: str, h: int, damage: int) -> str:
    return word if h % damage else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counted(damage: int, least: int):
    """(doc_id, text) batches -> words of at least `least` letters with counts, once per block."""

    def block(ids: list, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        low = _LOWER[data]
        lead = low == 0xC3  # in UTF-8 the letters U+00C0 .. U+00FF are this byte and one more
        letter = ((low >= 97) & (low <= 122)) | lead
        letter[1:] |= lead[:-1]
        breaks = np.zeros(len(low) + 1, dtype=bool)
        breaks[at] = True
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1] | breaks[1:-1]
        last[:-1] &= ~letter[1:] | breaks[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        leads = np.concatenate([[0], np.cumsum(lead)])
        long = end - start - (leads[end] - leads[start]) >= least
        start, end = start[long], end[long]
        doc = np.searchsorted(at, start, side="right") - 1
        before = np.array([0 if i is None else zlib.crc32(b"%d:" % i) for i in ids], dtype=np.uint32)
        known = np.array([i is not None for i in ids], dtype=bool)
        h = _crc32(low, start, end - start, before[doc])
        hit = (h % np.uint32(damage) == 0) & known[doc]
        changed: dict[str, int] = {}
        for k in np.flatnonzero(hit):
            word = _damaged(low[start[k] : end[k]].tobytes().decode(), int(h[k]), damage)
            if len(word) >= least:
                changed[word] = changed.get(word, 0) + 1
        start, end = start[~hit], end[~hit]
        up, down = _power(len(low) + 1)
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        _, one, n = np.unique(mix((sums[end] - sums[start]) * down[start]), return_index=True, return_counts=True)
        letters, bounds = _gather(low, start[one], (end - start)[one])
        words = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())
        words = pa.concat_arrays([words, pa.array(list(changed), pa.string())])
        return words, np.concatenate([n, np.fromiter(changed.values(), np.int64, len(changed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = string_buffers(batch.column("text"))
            for i, j in blocks(offsets, BLOCK):
                words, n = block(ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(doc_id, text) -> word, n: runs of letters with A-Z in lower case, of so many letters and occurrences at least.

    One letter goes from a run whose crc32 with its doc_id is divisible by damage; not where doc_id is null. Null and empty
    texts have no words. Blocks of texts are counted first, in the tasks that read them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counted(damage, least_letters), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Letters:
    """Words as Latin-1 bytes, one after the other, with their vectors."""

    def __init__(self, column: pa.Array, order: list[int]):
        data, self.bounds = string_buffers(column.cast(pa.string()))
        lead = data[self.bounds[0] : self.bounds[-1]] == 0xC3
        trail = np.concatenate([[False], lead[:-1]]) if len(lead) else lead
        latin = np.where(trail, data[self.bounds[0] : self.bounds[-1]] + np.uint8(64), data[self.bounds[0] : self.bounds[-1]])
        seen = np.concatenate([[0], np.cumsum(~lead)])
        self.bounds = seen[self.bounds - self.bounds[0]]
        self.data = latin[~lead]
        self.size = np.diff(self.bounds)
        self.n = len(self.size)
        place = np.empty(GROUPS, np.int64)
        place[order] = np.arange(GROUPS)
        cell = np.repeat(np.arange(self.n), self.size) * GROUPS + place[self.data & (GROUPS - 1)]
        self.vectors = np.bincount(cell, minlength=self.n * GROUPS).reshape(self.n, GROUPS)
        up, self.down = _power(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=self.sums[1:])

    def part(self, word: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.bounds[word] + start
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, GROUPS))
    for batch in batches:
        v = Letters(batch.column("word"), list(range(GROUPS))).vectors.astype(float)
        total += np.stack([v.sum(axis=0), (v * v).sum(axis=0)])
    yield pa.RecordBatch.from_arrays([pa.array(list(range(2 * GROUPS)), pa.int32()), pa.array(total.ravel())], names=["k", "x"])


def group_order(words: DataFrame) -> list[int]:
    """Letter groups by falling variance of their counts."""
    n = max(1, words.count())
    found = words.select("word").mapInArrow(_moments, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # 32 rows
    x = {r["k"]: r["x"] / n for r in found}
    return sorted(range(GROUPS), key=lambda g: (x.get(g, 0) ** 2 - x.get(GROUPS + g, 0), g))


class Branches:
    """The nodes of the trie that branch: keys of (parent, count), whose place is the child's number; the root is number 0."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.int64)
        self.children = np.zeros(0, dtype=np.int64)
        self.root = False

    def child(self, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The branching child, or -1."""
        key = (node << 32) | count
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def add(self, keys: list[int]) -> None:
        first = 1 + len(self.keys)
        all_keys = np.concatenate([self.keys, np.array(keys, dtype=np.int64)])
        children = np.concatenate([self.children, np.arange(first, first + len(keys))])
        order = np.argsort(all_keys)
        self.keys, self.children = all_keys[order], children[order]


def _paths(order: list[int], branches: Branches, depth: int):
    """Keys of the nodes of a depth below branching parents, with their words' number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Letters(batch.column("word"), order).vectors
            node = np.zeros(len(v), dtype=np.int64)
            for d in range(depth - 1):
                node = np.where(node < 0, -1, branches.child(np.maximum(node, 0), v[:, d]))
            key, n = np.unique(((node << 32) | v[:, depth - 1])[node >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def branching(words: DataFrame, order: list[int], cell: int = CELL, cells: int = CELLS) -> Branches:
    """The branching nodes, level by level: at most `cells` keys of a level come to the driver, and GROUPS levels."""
    total = words.count()
    most, found = max(cell, -(-total // cells)), Branches()
    found.root = total > most
    if not found.root:
        return found
    for depth in range(1, GROUPS):
        keys = words.select("word").mapInArrow(_paths(order, found, depth), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        full = [r["key"] for r in keys.filter(F.col("n") > most).select("key").collect()]
        if not full:
            break
        found.add(sorted(full))
    return found


def _reach(v: np.ndarray, branches: Branches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, cell, own): every word's own cell, and the later cells that a surplus and a deficit of one reach."""
    who = np.arange(len(v))
    if not branches.root:
        return who, np.full(len(v), -1), np.ones(len(v), dtype=bool)
    node, more, less = np.zeros(len(v), np.int64), np.zeros(len(v), bool), np.zeros(len(v), bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(GROUPS):
        ahead = []
        for step in (0, 1, -1):
            ok = np.flatnonzero((v[who, depth] + step >= 0) & (~more if step == 1 else ~less if step == -1 else True))
            w, count = who[ok], v[who[ok], depth] + step
            key, child = (node[ok] << 32) | count, branches.child(node[ok], count)
            end = child < 0
            up, down = more[ok] | (step == 1), less[ok] | (step == -1)
            out.append((w[end], key[end], ~(up | down)[end]))
            ahead.append((w[~end], child[~end], up[~end], down[~end]))
        who, node, more, less = (np.concatenate(x) for x in zip(*ahead, strict=True))
    word, cell, own = (np.concatenate(x) for x in zip(*out, strict=True))
    mine = np.empty(len(v), dtype=np.int64)
    mine[word[own]] = cell[own]
    later = own | (cell > mine[word])
    return word[later], cell[later], own[later]


def _entries(order: list[int], branches: Branches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, cell, own = _reach(Letters(batch.column("word"), order).vectors, branches)
            picked = pa.array(word)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), pa.array(own), batch.column("word").take(picked), batch.column("n").take(picked)],
                names=["cell", "own", "word", "n"],
            )

    return run


def _distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors in the order of the trie, the words by vector, and the vectors' bounds in them."""
    by = np.lexsort(v.T[::-1])
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[by][1:] != v[by][:-1]).any(axis=1)
    return v[by][new], by, np.append(np.flatnonzero(new), len(v))


def _descend(probe: np.ndarray, trie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of (probe vector, trie vector) that differ by a surplus and a deficit of one at most."""
    who, node = np.arange(len(probe)), np.zeros(len(probe), np.int64)
    more, less = np.zeros(len(probe), bool), np.zeros(len(probe), bool)
    above = np.zeros(len(trie), np.int64)
    base = int(max(trie.max(initial=0), probe.max(initial=0))) + 2
    for d in range(GROUPS):
        key = above * base + trie[:, d]  # sorted, as the vectors are
        keys, below = np.unique(key, return_inverse=True)
        ahead = []
        for step in (0, 1, -1):
            ok = np.flatnonzero((probe[who, d] + step >= 0) & (~more if step == 1 else ~less if step == -1 else True))
            wanted = node[ok] * base + probe[who[ok], d] + step
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            ok, at = ok[keys[at] == wanted], at[keys[at] == wanted]
            ahead.append((who[ok], at, more[ok] | (step == 1), less[ok] | (step == -1)))
        who, node, more, less = (np.concatenate(x) for x in zip(*ahead, strict=True))
        above = below
    return who, node


def _expand(bounds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i of `of` the places bounds[i] .. bounds[i + 1], with the number of the i that they are for."""
    size = bounds[of + 1] - bounds[of]
    at = np.concatenate([[0], np.cumsum(size)])
    return np.arange(at[-1]) + np.repeat(bounds[of] - at[:-1], size), np.repeat(np.arange(len(of)), size)


def _halves(a: Letters, word: np.ndarray, pair: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Two keys for each word of a pair of leaves: of the first half of the shorter word's length, and of the rest at the end."""
    m = shorter[pair]
    first = a.part(word, np.zeros(len(word), np.int64), m // 2)
    rest = a.part(word, a.size[word] - (m - m // 2), m - m // 2)
    turn = np.uint64(0x9FB21C651E98DF25)
    own = pair.astype(np.uint64) * np.uint64(2)
    return np.concatenate([mix(first + own * turn), mix(rest + (own + np.uint64(1)) * turn)])


def _one_edit(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(i), dtype=bool)
    length = np.maximum(a.size[i], b.size[j])
    power = np.ceil(np.log2(np.maximum(length, 1))).astype(int)  # words of like length together, so that padding stays small
    for p in np.unique(power):
        alike, step = np.flatnonzero(power == p), max(1, LETTERS >> int(p))
        for k in range(0, len(alike), step):
            part = alike[k : k + step]
            x, y, at = a.size[i[part]], b.size[j[part]], np.arange(int(length[part].max()))
            m = np.minimum(x, y)
            inside = at < m[:, None]
            letters = lambda s, start: s.data[np.minimum(start[:, None] + at, len(s.data) - 1)]  # noqa: B023, E731
            front = letters(a, a.bounds[i[part]]) == letters(b, b.bounds[j[part]])
            # right-aligned: the last m letters of both
            back = letters(a, a.bounds[i[part]] + x - m) == letters(b, b.bounds[j[part]] + y - m)
            replaced = (~front & inside).sum(axis=1) == 1
            head = np.logical_and.accumulate(front & inside, axis=1).sum(axis=1)
            wrong = ~back & inside
            tail = np.where(wrong.any(axis=1), m - 1 - (len(at) - 1 - np.argmax(wrong[:, ::-1], axis=1)), m)
            out[part] = np.where(x == y, replaced, (np.abs(x - y) == 1) & (head + tail >= m))
    return out


def _search(order: list[int]):
    """Near pairs of a cell's words, and of its words and probes."""

    def near(a: Letters, b: Letters, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        probes, by_probe, probe_bounds = _distinct(a.vectors)
        trie, by_word, word_bounds = _distinct(b.vectors)
        for k in range(0, len(probes), TOGETHER):
            pv, rv = _descend(probes[k : k + TOGETHER], trie)
            shorter = np.minimum(probes[k + pv].sum(axis=1), trie[rv].sum(axis=1))
            one, pair_one = _expand(probe_bounds, k + pv)
            two, pair_two = _expand(word_bounds, rv)
            one, two = by_probe[one], by_word[two]
            left, right = _halves(a, one, pair_one, shorter), _halves(b, two, pair_two, shorter)
            one, two = np.tile(one, 2), np.tile(two, 2)
            by_key = np.argsort(right)
            low, high = (np.searchsorted(right[by_key], left, side=s) for s in ("left", "right"))
            size = high - low
            i = np.repeat(one, size)
            j = two[by_key[np.arange(size.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]]
            met = np.unique((i * b.n + j)[i < j] if same else i * b.n + j)
            i, j = met // max(1, b.n), met % max(1, b.n)
            good = _one_edit(a, i, b, j)
            yield i[good], j[good]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.filter(table.column("own"))
        probes = table.filter(pa.compute.invert(table.column("own")))
        out = []
        if own.num_rows:
            words = Letters(own.column("word").combine_chunks(), order)
            sides = [(own, words, True)]
            if probes.num_rows:
                sides.append((probes, Letters(probes.column("word").combine_chunks(), order), False))
            for rows, letters, same in sides:
                for i, j in near(letters, words, same):
                    out.append([rows.column("word").take(pa.array(i)), rows.column("n").take(pa.array(i)), own.column("word").take(pa.array(j)), own.column("n").take(pa.array(j))])
        columns = [pa.chunked_array([c for x in out for c in x[k].chunks], type=(pa.string(), pa.int64())[k % 2]) for k in range(4)]
        return pa.table(columns, names=["a", "a_n", "b", "b_n"])

    return run


def near_pairs(words: DataFrame, cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """(word, n), distinct words of letters up to U+00FF in a written table -> a, a_n, b, b_n: each pair at one edit, once.

    Words of one whole vector share a cell whatever their number; inside it they meet by halves.
    """
    order = group_order(words)
    branches = branching(words, order, cell, cells)
    entries = words.select("word", "n").mapInArrow(_entries(order, branches), "cell bigint, own boolean, word string, n bigint")
    return entries.groupBy("cell").applyInArrow(_search(order), "a string, a_n bigint, b string, b_n bigint")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> word, form, root, n, n_near, form_n: the near word of largest n, if that is ratio times the word's own n.

    Of near words with equal n the first in code-point order counts; root follows forms to the last one. Words must be
    distinct; an empty table gives no rows. Counts rise by ratio from form to form, so that root ends.
    """
    with Tables(words.sparkSession) as tables:
        known = tables.write(words.select("word", "n"), "vocabulary")
        pairs = tables.write(near_pairs(known), "near")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
        best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("back"), "b")).alias("top"))
        found = known.join(best, "word", "left")
        follows = -F.col("top.back") >= ratio * F.col("n")
        found = tables.write(
            found.select(
                "word",
                F.when(follows, F.col("top.b")).alias("form"),
                "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(follows, -F.col("top.back")).alias("form_n"),
            ),
            "forms",
        )
        steps, reach = 1, known.agg(F.max("n").alias("n")).first()["n"] or 1
        while reach >= ratio:
            reach, steps = reach // ratio, steps + 1
        root = found.filter("form is not null").select("word", F.col("form").alias("root"))
        for _ in range(steps.bit_length()):  # each turn doubles the forms that root has followed
            root = tables.write(root, "root")
            ahead = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
            root = root.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        out = found.join(root, "word", "left")
        return materialize(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents; nulls and ties as in vocabulary and group_variants."""
    return group_variants(vocabulary(documents(spark, sf_dir)))


OP13_SQL = """
with recursive crc as (
  select list_transform(range(256), lambda k: list_reduce(list_concat([k], range(8)), lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) as tab
), tok as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents
), cnt as (select doc_id, w, count(*) as n from tok where length(w) >= 6 group by all
), byte as (
  select *, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c) - 64] end)) as bytes from cnt
), hashed as (
  select w, n, xor(list_reduce(list_concat([4294967295::bigint], bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::bigint) as h from byte, crc
), res as (
  select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from hashed
), v as (select word, sum(n)::bigint as n from res where length(word) >= 6 group by 1 having sum(n) >= 5
), del as (select word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as d from (select word, unnest(range(length(word))) as i from v)
), one as (
  select a.word as a, b.word as b from del a join del b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select del.word, v.word from del join v on v.word = del.d union select v.word, del.word from del join v on v.word = del.d
), best as (
  select a as word, count(*) as n_near, arg_min(b, struct_pack(x := -v.n, y := b)) as top, max(v.n) as top_n from one join v on v.word = b group by 1
), f as (
  select word, case when top_n >= 5 * n then top end as form, n, coalesce(n_near, 0) as n_near, case when top_n >= 5 * n then top_n end as form_n from v left join best using (word)
), r as (
  select word, form as root from f where form is not null union all select r.word, f.form from r join f on f.word = r.root where f.form is not null
)
select f.word, f.form, coalesce(e.root, f.word) as root, f.n, f.n_near, f.form_n
from f left join (select r.* from r join f on f.word = r.root where f.form is null) e on e.word = f.word
"""
