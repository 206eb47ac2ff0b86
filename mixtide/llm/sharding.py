"""Sharding by a Feistel permutation of global row numbers (operator 9). DataFrame functions only.

Rows are numbered 0 .. N-1 in the order of (doc_id, text_crc32, size): a range sort, then row numbers inside
partitions plus the partitions' offsets. A keyed generalized Feistel network permutes a * b >= N places; numbers
that land outside 0 .. N-1 walk on along their cycle. Place p is shard p mod shards, slot p div shards.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import Tables, documents, materialize

ROUNDS = 4
SHARDS = 8


def domain(n: int) -> tuple[int, int]:
    """The sides a, b of the permuted grid: a * b >= n, less than a + b beyond it."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of 0 .. a * b - 1: each round shifts one half by a keyed hash of the other."""

    def one(s: Column, r: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], r, F.lit(seed)), F.lit(a)), F.lit(a))
        return F.struct(left.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(left, r, F.lit(seed + 1)), F.lit(b)), F.lit(b)).alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).alias("r"))
    rounds = F.array(*[F.lit(k).cast("long") for k in range(ROUNDS)])
    return F.aggregate(rounds, start, one, lambda s: s["l"] * F.lit(b) + s["r"])


def permute(x: Column, n: int, seed: int) -> Column:
    """A permutation of 0 .. n - 1. A walk leaves the a * b - n outside places within so many steps, so it ends."""
    a, b = domain(n)
    steps = F.sequence(F.lit(1), F.lit(max(1, a * b - n + 1)))
    once = feistel(x, a, b, seed)
    walk = lambda p: F.aggregate(steps, p, lambda q, _: F.when(q < n, q).otherwise(feistel(q, a, b, seed)))
    return F.element_at(F.transform(F.array(once), lambda p: F.when(p < n, p).otherwise(walk(p))), 1)


def number_rows(df: DataFrame, tables: Tables, *order: str) -> DataFrame:
    """df with row_number (0 .. N-1) in the given order, without a global window: range sort, then offsets of partitions."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    # written before it is counted: the bounds of the ranges may differ from one execution to the next
    ranged = ranged.withColumn("__part", F.shiftright("__id", 33)).withColumn("__in", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = tables.write(ranged, "ranged")
    offsets, total = [0], 0
    for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():  # one row per partition
        offsets += [total] * (r["__part"] + 1 - len(offsets))
        total += r["n"]
        offsets.append(total)
    known = F.from_json(F.lit(json.dumps(offsets)), "array<bigint>")  # one entry per partition
    return ranged.withColumn("row_number", F.get(known, F.col("__part").cast("int")) + F.col("__in")).drop("__id", "__part", "__in")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, row_number, shard, slot; one row per input row.

    size: UTF-8 bytes plus 1; null text counts as empty. Rows equal in doc_id, crc and size are interchangeable; null
    doc_ids come first. Shards differ by one row at most and their slots have no gaps. The same rows give the same
    shards and slots, whatever their partitions. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    with Tables(docs.sparkSession) as tables:
        rows = number_rows(tables.write(rows, "sizes"), tables, "doc_id", "text_crc32", "size")
        place = permute(F.col("row_number"), max(1, rows.count()), seed)
        out = rows.withColumn("__place", place)
        shard_, slot = F.pmod("__place", F.lit(shards)).cast("int"), F.floor(F.col("__place") / shards).cast("long")
        return materialize(out.select("doc_id", "size", "text_crc32", "row_number", shard_.alias("shard"), slot.alias("slot")), "shards")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law rows; nulls and ties as in shard."""
    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
