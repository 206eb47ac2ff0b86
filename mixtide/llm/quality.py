"""Quality rules by hashed n-gram log-likelihood ratio (operator 8). DataFrame functions only.

Word unigrams and bigrams are hashed into BUCKETS. Two multinomials are counted: the raw corpus (every document)
and the trusted target (labelled rows of quality 1, at most TRUSTED of them, those of smallest hash). A document's
score is the mean over its n-grams of the log ratio target / raw; documents under THRESHOLD are not kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import WORD, Tables, documents

BUCKETS = 1 << 17
TRUSTED = 500_000
THRESHOLD = -0.25
SMOOTHING = 0.5


def let(value: Column, body) -> Column:
    """body(x) with x bound to value once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def ngram_buckets(words: Column) -> Column:
    """Buckets of the lower-cased words and of their neighbouring pairs."""

    def of(h: Column) -> Column:
        pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), pairs)

    return let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), of)


def repeated_window_words(words: Column, size: int = 8) -> Column:
    """Words inside windows of size words that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        # (hash, place) in order: a window repeats if a neighbour has its hash; then the union of their spans
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda p: let(
            F.array_sort(F.transform(F.filter(
                F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])).alias("twice"))),
                lambda x: x["twice"]), lambda x: x["i"])),
            lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
                                   lambda s, i: F.struct((s["n"] + F.least(F.lit(size), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])))

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))
        return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x)))

    return F.when(F.size(words) <= size, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), count))


def log_ratios(docs: DataFrame, labels: DataFrame, most_trusted: int = TRUSTED) -> list[float]:
    """The BUCKETS log ratios, as many whatever the corpus; at most most_trusted labelled rows are learned from."""
    with Tables(docs.sparkSession) as tables:
        return _log_ratios(docs, labels, most_trusted, tables).first()["ratios"]


def _log_ratios(docs: DataFrame, labels: DataFrame, most_trusted: int, tables: Tables) -> DataFrame:
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = tables.write(trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_trusted), "trusted")
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ngram_buckets(word_list()).alias("buckets")).join(F.broadcast(trusted.withColumn("target", F.lit(1))), "doc_id", "left")
    grams = flagged.select(F.explode("buckets").alias("bucket"), F.coalesce("target", F.lit(0)).alias("target"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("x"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    smooth = F.lit(SMOOTHING)
    ratio = lambda e: F.ln((e["target"] + smooth) / (F.col("all_target") + smooth * BUCKETS)) - F.ln((e["raw"] + smooth) / (F.col("all_raw") + smooth * BUCKETS))
    return one.select(F.when(F.col("all_target") > 0, F.transform("x", ratio)).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("ratios"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_trusted: int = TRUSTED) -> DataFrame:
    """(doc_id, text), (doc_id, quality) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr, kept; one row per input row.

    Null text has no words: all counts are 0, base_failed is true, llr is 0. Without a trusted row every llr is 0.
    kept is false if base_failed, else llr >= threshold. Repeated rows give equal rows, an empty table no rows. Of the
    labelled rows of quality 1 those of the most_trusted smallest hashes are the trusted target. Other columns are ignored.
    """
    table = log_ratios(docs, labels, most_trusted)
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")  # folded to one literal when the plan is made
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("words", word_list())
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    mean = let(ngram_buckets(F.col("words")), lambda b: F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(ratios, i)) / F.greatest(F.size(b), F.lit(1)))
    out = one.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", WORD, ""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_window_words(F.col("words")).cast("long").alias("n_repeat_words"),
        mean.alias("llr"),
    )
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document; nulls and repeats as in quality."""
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
