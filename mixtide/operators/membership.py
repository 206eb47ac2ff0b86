"""Which class a molecule belongs to: numbered count classes, likelihood classes and sets of compatible origins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtide.functions.arrays import lists, matrix
from mixtide.functions.math import bind
from mixtide.functions.ranks import running_totals
from mixtide.operators.classes import count_classes, join_classes
from mixtide.operators.likelihood import check_profiles, score

def numbered(classes: DataFrame, name: str, *key: str) -> DataFrame:
    """classes with their number from 0 on in the order of key, which tells them apart: the same whatever the partitions."""
    found = running_totals(classes.withColumn("__one", F.lit(1)), [F.col(k) for k in key], "__one")
    return found.withColumnRenamed("before___one", name).drop("__one")


def membership(counts: DataFrame, q: list[list[float]], digits: int = 9) -> DataFrame:
    """(molecule, observed, positive) -> molecule, count_class, likelihood_class, log_offset (JN4, AGG5).

    Count classes are numbered by (observed, positive), likelihood classes by their centred scores, which are rounded to so
    many digits so that equals meet. A molecule's scores are its likelihood class's plus log_offset. One row per molecule.
    """
    classes = numbered(count_classes(counts), "count_class", "observed", "positive")
    scored = score(classes, q).withColumn("log_offset", F.array_max("ll"))
    centred = bind(F.col("log_offset"), lambda top: F.transform("ll", lambda x: F.round(x - top, digits) + F.lit(0.0)))
    scored = scored.withColumn("centred", centred)
    groups = numbered(scored.select("centred").distinct(), "likelihood_class", "centred")
    hop = scored.join(groups, "centred").select("observed", "positive", "n", "count_class", "likelihood_class", "log_offset").checkpoint()
    met = join_classes(counts.select("molecule", "observed", "positive"), hop, "observed", "positive")
    return met.select("molecule", "count_class", "likelihood_class", "log_offset")


def _compatible(profiles: list[list[int]], columns: list[str]):
    p = np.asarray(profiles, float).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, hit = (matrix(batch.column(c), len(p), c) for c in ("observed", "positive"))
            wrong = hit @ (1 - p) + (seen - hit) @ p
            best = wrong == wrong.min(axis=1, keepdims=True)
            best = np.pad(best, ((0, 0), (0, -best.shape[1] % 64)))
            words = np.packbits(best, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists(words, pa.int64())], names=[*columns, "compatible"])

    return run


def with_compatible(classes: DataFrame, profiles: list[list[int]]) -> DataFrame:
    """classes (observed, positive) with compatible: the origins of fewest mismatches as bits of 64-bit words, origin 0 lowest."""
    check_profiles(profiles)
    plain = classes.drop("compatible")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in plain.dtypes), "compatible array<bigint>"])
    return plain.mapInArrow(_compatible(profiles, plain.columns), schema)


def binary_classes(classes: DataFrame, profiles: list[list[int]]) -> DataFrame:
    """(observed, positive, n) -> compatible, n, members: classes that leave the same origins possible are one (AGG7).

    members counts the classes that met. A missing call fits every profile. Sets are compared as packed bits.
    """
    found = with_compatible(classes, profiles).groupBy("compatible")
    return found.agg(F.sum("n").alias("n"), F.count("*").alias("members"))


def origins_in(compatible: Column, n_origins: int) -> Column:
    """The origins of a packed set, in order."""
    every = F.sequence(F.lit(0), F.lit(n_origins - 1))
    return F.filter(every, lambda k: F.getbit(F.get(compatible, F.floor(k / 64).cast("int")), k % 64) == 1)


def binary_scores(compatible: Column, n_origins: int) -> Column:
    """ll of a packed set: 0 for its origins, else -Infinity."""
    every = F.sequence(F.lit(0), F.lit(n_origins - 1))
    inside = lambda k: F.getbit(F.get(compatible, F.floor(k / 64).cast("int")), k % 64) == 1
    return F.transform(every, lambda k: F.when(inside(k), F.lit(0.0)).otherwise(F.lit("-Infinity").cast("double")))
