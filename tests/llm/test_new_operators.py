"""Digest index, periodic runs and spelling variants against brute force, and on nulls, repeats and empty tables."""

import bisect
import collections
import hashlib
import pathlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtide.llm import runs as R
from mixtide.llm import spelling as S
from mixtide.llm._common import shared_dir
from mixtide.llm.digest_index import OP11_SQL, DigestIndex, digest_of, exact_dedup, op11_exact_dedup
from mixtide.llm.mixing import assign, mix
from mixtide.llm.secrets import redact
from mixtide.llm.sharding import shard
from mixtide.llm.warc import shard_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, collapsed int, row int, `c0` int, batch int, `a``b` int"


def odd_rows():
    texts = [None, "", " \n ", "one", "Two two", "ab " * 40, "ab " * 40, "x y z " * 9000, "é ß " * 14, "\x01 \x02"]
    rows = [(k, t, "r", 1, 2, 3, 4, 5) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "ab " * 40, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = op11_exact_dedup(spark, SF)
    columns = sorted(got.columns)
    want = con.execute(OP11_SQL).df()[columns]
    assert sorted(map(tuple, got.toPandas()[columns].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_exact_dedup_of_odd_rows(odd, empty):
    rows = odd_rows()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup(odd).collect()
    assert len(got) == len(rows) and exact_dedup(empty).count() == 0
    for r in got:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_splits_hot_groups(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup(docs).groupBy("kept").agg(F.count("*"), F.max("group_size")).collect()
    assert {tuple(r) for r in got} == {(True, 2001, 1000), (False, 999, 1000)}


def test_index_keeps_what_is_new(spark, odd, tmp_path):
    path = f"{tmp_path}/it's an index"
    index = DigestIndex(spark, path, 8)
    first = index.keep_new(odd.filter("doc_id < 6"), 1)
    assert first.columns == odd.columns and {r["doc_id"] for r in first.collect()} == {2, 1, 3, 4, 5}
    again = DigestIndex(spark, path, 99)
    assert again.buckets == 8
    second = again.keep_new(odd, 2)
    assert sorted(r["doc_id"] for r in second.collect()) == [7, 8, 9]
    before = sorted(map(tuple, again.entries().collect()))
    assert sorted(r["doc_id"] for r in again.keep_new(odd, 2).collect()) == [7, 8, 9]  # the same batch once more
    again.compact()
    assert sorted(map(tuple, again.entries().collect())) == before == sorted(map(tuple, DigestIndex(spark, path).entries().collect()))
    assert again.keep_new(odd.limit(0), 3).count() == 0
    plan = odd.select(digest_of(F.col("text")).alias("digest")).join(again.entries().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def brute_runs(x):
    ids: dict = {}
    x, out = np.array([ids.setdefault(v, len(ids)) for v in x]), {}
    for q in range(1, len(x) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= q:
                out.setdefault((s, e + q), q)
    return {(s, e, q) for (s, e), q in out.items()}


def hashes(x):
    return np.array([(v + 1) * 0x9E3779B97F4A7C15 % 2**64 for v in x], dtype=np.uint64)


def test_runs_of_random_sequences():
    rng = random.Random(3)
    for _ in range(250):
        x = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(4)):
            m = rng.randrange(2, 9)
            x = (x * m)[: max(1, len(x) * m - rng.randrange(len(x) + 1))] + [rng.randrange(3) for _ in range(rng.randrange(4))]
            x = x[rng.randrange(len(x)) :][:500] or [0]
        assert {tuple(r) for r in R.runs_of(hashes(x), len(x)).tolist()} == brute_runs(x)


def test_runs_over_the_end_of_a_periodic_region(monkeypatch):
    root = (0, 0, 1) * 30
    x = [2, *(root[:70] * 2), 2]
    assert (1, 141, 70) in {tuple(r) for r in R.runs_of(hashes(x), len(x)).tolist()}
    monkeypatch.setattr(R, "_seams", lambda *_: (np.zeros(0, np.int64),) * 2)
    assert (1, 141, 70) not in {tuple(r) for r in R.runs_of(hashes(x), len(x)).tolist()}


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted((s, e - s, q) for s, e, q in brute_runs(w) if e - s >= 12) if n < 8000 else None
    if runs is None:
        return None
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in R.op12_runs(spark, SF).collect()}
    assert len(got) == len(docs) and any(v[0] for v in got.values())
    for d in docs:
        assert got[d["doc_id"]] == expected_runs(*d)


def test_runs_of_odd_rows(odd, empty):
    assert R.find_runs(empty).count() == 0
    got = R.find_runs(odd.repartition(1)).collect()
    assert len(got) == len(odd_rows()) and {"row", "c0", "batch", "a`b"} <= set(got[0].asDict())
    for r in got:
        words = len(WORD.findall(r["text"] or ""))
        want = {40: [(0, 40, 1)], 27000: [(0, 27000, 3)], 28: [], 14: [(0, 14, 1)]}.get(words, [])
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == " ".join(WORD.findall(r["text"] or "")[: want[0][2] if want else None])


def test_tail_of_odd_rows(odd):
    got = odd.select("text", R.repeated_tail(F.col("doc_id"), F.col("text")).alias("moved")).collect()
    assert all(r["moved"] == r["text"] or len(WORD.findall(r["text"] or "")) == len(WORD.findall(r["moved"] or "")) for r in got)


def brute_words(rows):
    low, count = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            count[w if h % 199 or doc_id is None else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def brute_variants(words):
    near = collections.defaultdict(set)
    by_rest = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_rest[w[:k], w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in by_rest.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v and words[v] >= 5 * words[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["word"]: tuple(r)[1:] for r in S.op13_spelling(spark, SF).collect()}
    assert got == brute_variants(brute_words(rows)) and any(v[0] for v in got.values())


def test_small_cells_find_the_same_pairs(spark, tmp_path):
    rng, words = random.Random(4), {}
    letters = "abcdeéèuÿÀ"
    for _ in range(250):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 9)))
        for _ in range(4):
            words[w] = rng.randrange(5, 4000)
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
    words |= {"".join(p) + "z" * m: 7 for p in ("abcdefgh", "abcdefhg", "bacdefgh") for m in (0, 1, 70, 300)} | {"chaina": 5, "chainab": 30, "chainabc": 200}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    table.write.parquet(f"{tmp_path}/words")
    table = spark.read.parquet(f"{tmp_path}/words")
    want = {frozenset((w, v)) for w in words for v in words if w < v and abs(len(w) - len(v)) < 2 and brute_near(w, v)}
    for cell in (5, 60, 100000):
        found = S.near_pairs(table, cell).collect()
        assert len(found) == len(want) and {frozenset((r["a"], r["b"])) for r in found} == want
        assert all(words[r["a"]] == r["a_n"] and words[r["b"]] == r["b_n"] for r in found)
    got = {r["word"]: tuple(r)[1:] for r in S.group_variants(table).collect()}
    assert got == brute_variants(words)
    assert got["chaina"][:2] == ("chainab", "chainabc")


def brute_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = (u, v) if len(u) > len(v) else (v, u)
    return any(u[:k] + u[k + 1 :] == v for k in range(len(u)))


def test_vocabulary_of_odd_rows(spark, empty):
    long = "AbÀ" * 200
    rows = [(1, f"{long} {long}"), (2, None), (3, ""), (None, f"abcdef,abcdefĀabcdef× {long}"), (4, "ABCDEF " * 9), (4, "ABCDEF " * 9), (5, f"{long} {long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2)})
    assert {r["word"]: r["n"] for r in S.vocabulary(docs).collect()} == brute_words(rows)
    assert S.vocabulary(empty).count() == 0 and S.group_variants(S.vocabulary(empty)).count() == 0


def test_mix_keeps_the_columns_of_rows_that_share_a_text(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "A", "x"), (1, text, "B", "y"), (2, text + " more", "A", None), (3, "other words", "B", "z"), (3, "other words", "B", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string")
    got = collections.Counter(tuple(r)[2:] for r in mix(docs).filter("doc_id = 1").collect())
    plan = assign(docs).filter("doc_id = 1").select("source", "copies").collect()
    assert got == collections.Counter({(r["source"], {"A": "x", "B": "y"}[r["source"]]): r["copies"] for r in plan if r["copies"]})
    assert mix(docs).filter("doc_id = 3").count() == sum(r["copies"] for r in assign(docs).filter("doc_id = 3").collect())


def test_stages_leave_no_tables(spark, odd):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    shard(docs).count()
    mix(docs).count()
    redact(docs).count()
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} <= {"shards", "plan", "secrets"}


def test_shards_of_places(spark):
    bounds = ["", "b", "d", "dd", "x"]
    rows = spark.createDataFrame([(p,) for p in ("", "a", "b", "c", "d", "dd", "ddd", "w", "x", "z")], "at string")
    for k in range(len(bounds) + 1):
        got = rows.select("at", shard_of(F.col("at"), bounds[:k]).alias("s")).collect()
        assert all(r["s"] == max(0, bisect.bisect_right(bounds[:k], r["at"]) - 1) for r in got)
