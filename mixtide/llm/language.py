"""Language identification as inference of a language mixture (operator 6).

A document is a bag of byte trigrams (A-Z lower-cased; ASCII characters other than letters count as spaces).
Learning sums trigram counts per language over all training rows. For a document, expectation-maximisation
estimates the proportions of languages from the trigrams' smoothed likelihoods; the sets of the 1, 2, ... most
probable languages are fitted in turn and the set of the best penalised likelihood is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import VECTOR_SCHEMA, documents, sum_vectors, vector_rows
from mixtide.llm._text import blocks, string_buffers

BUCKETS = 1 << 16
ROUNDS = 10
#: Log-likelihood that a further language must bring, per document and per trigram of it.
PENALTY, PENALTY_SHARE = 8.0, 0.02
UNKNOWN = "und"
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bucket, document) of blocks of whole documents; runs of spaces give nothing."""
    data, offsets = string_buffers(column)
    for i, j in blocks(offsets):
        raw = _FOLD[data[offsets[i] : offsets[j]]]
        doc = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        if len(raw) < 3:
            yield i, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        code = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
        use = (doc[:-2] == doc[2:]) & (raw[1:-1] != 32)
        yield i, ((code[use] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), doc[:-2][use]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in set(langs):  # a language whose texts have no trigram is learned as well
            total.setdefault(lang, np.zeros(BUCKETS))
        for first, bucket, doc in trigrams(batch.column("text")):
            own = langs[first:][doc] if len(doc) else langs[:0]
            for lang in dict.fromkeys(langs[first : first + (doc.max() + 1 if len(doc) else 0)]):
                total[lang] += np.bincount(bucket[own == lang], minlength=BUCKETS)
    context = TaskContext.get()
    yield from vector_rows({f"l:{k}": np.append(v, 1.0) for k, v in total.items()}, context.partitionId() if context else 0)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-likelihood of each bucket under each: (buckets, languages)."""
    rows = docs.filter("lang is not null").select("lang", "text").mapInArrow(_learn, VECTOR_SCHEMA)
    sums = sum_vectors(rows)
    langs = sorted(k[2:] for k in sums)
    counts = np.stack([sums[f"l:{k}"][:BUCKETS] for k in langs], axis=1) if langs else np.zeros((BUCKETS, 0))
    return langs, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)


def infer(like: np.ndarray, times: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Proportions of the languages of the best penalised set, (documents, languages), for documents that have trigrams.

    like: log-likelihood rows of distinct trigrams, ordered by document; times: their counts; starts: first row
    of each document; doc: each row's document (0, 1, ...). Sets are fitted in order of size; a document is left out
    from the size on at which the likelihood of all languages together could not pay for one more.
    """
    n_docs, k_all = len(starts), like.shape[1]
    every_size = np.add.reduceat(times, starts)

    def fit(allowed: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = np.isin(doc, docs) if len(docs) < n_docs else slice(None)
        own, n, number = like[use], times[use], doc[use]
        at = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
        top = own.max(axis=1)
        p = np.exp(own - top[:, None])
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            joint = p * pi[number]
            pi = np.add.reduceat(joint * (n / joint.sum(axis=1))[:, None], at, axis=0) / every_size[docs][:, None]
        with np.errstate(divide="ignore"):
            value = np.add.reduceat(n * (np.log(np.maximum((p * pi[number]).sum(axis=1), 1e-300)) + top), at)
        return pi, value

    whole, most = fit(np.ones((n_docs, k_all)), np.arange(n_docs))
    rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
    price = PENALTY + PENALTY_SHARE * every_size
    best_pi = (rank == 0).astype(float)
    best = np.add.reduceat(times * like[np.arange(len(like)), np.argmax(rank == 0, axis=1)[doc]], starts) - price
    for k in range(2, k_all + 1):
        docs = np.flatnonzero(most - k * price > best)
        if not len(docs):
            break
        pi, value = (whole[docs], most[docs]) if k == k_all else fit((rank[docs] < k).astype(float), docs)
        value = value - k * price[docs]
        better = value > best[docs]
        best[docs[better]], best_pi[docs[better]] = value[better], pi[better]
    return best_pi


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        names = np.array([*langs, UNKNOWN], dtype=object)
        for batch in batches:
            n = batch.num_rows
            pred, score, shares = np.full(n, len(langs)), np.zeros(n), np.zeros((n, len(langs)))
            letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            if langs:
                shares[letters] = 1.0 / len(langs)  # too short for a trigram: all alike
                for first, bucket, doc in trigrams(batch.column("text")):
                    if not len(doc):
                        continue
                    key = np.sort(doc << 16 | bucket)
                    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    times, rows, d = np.diff(np.append(at, len(key))).astype(float), key[at] & 0xFFFF, key[at] >> 16
                    starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                    number = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]]))
                    at = first + d[starts]
                    shares[at] = np.where(letters[at][:, None], infer(table[rows], times, starts, number), 0.0)
                pred[letters] = np.argmax(shares[letters], axis=1)
                score[letters] = shares[letters, pred[letters]]
            row, lang = np.nonzero(shares)
            mixture = pa.MapArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(names[lang], pa.string()), pa.array(shares[row, lang]))
            keep = [c for c in batch.schema.names if c not in ("text", "__letters")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0.0, 1.0)), mixture], names=[*keep, "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, training: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lang_pred, score, mixture for each row of docs, learned from the text and lang of training.

    lang_pred is a lang value of training, or und if the text is null or has no letter, or if nothing could be
    learned; score is the language's share in the text (0 for und). A text with letters but no trigram gets the
    first language and an even share. mixture: the languages of the chosen set with their proportions (none for und).
    Repeated rows give equal rows, an empty table no rows; no key may be named like a result. Ties go to the language that is first by code point. Neither lang nor any
    other column of docs takes part in a prediction.
    """
    spark = docs.sparkSession
    model = learn(training)
    shared = spark.sparkContext.broadcast(model)  # one row of BUCKETS numbers per language
    named = docs.select(*keys, F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in named.dtypes if c in keys), "lang_pred string", "score double", "mixture map<string,double>"])
    return named.mapInArrow(_predict(shared), schema)


def held_out_column():
    """crc32 of the doc_id as text leaves 1 when divided by 3 (a null doc_id counts as 0)."""
    return F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")) % 3 == 1


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, with the chosen set's proportions; nulls and ties as in identify."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out_column().alias("held_out"))
    return identify(docs, docs.filter("not held_out"), ["doc_id", "held_out"])
