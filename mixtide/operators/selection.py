"""Yield and selection: compositions before and after a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_yield(recovery: Column, visibility: Column) -> Column:
    return recovery * visibility


def source_to_analyzed(weights: DataFrame) -> DataFrame:
    """(origin, w, e) -> analyzed share, w * e normalised (YD2); one row per origin."""
    total = F.sum(F.col("w") * F.col("e")).over(Window.partitionBy())
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("no origin is seen: the weighted yields sum to 0")).cast("double"))
    return weights.withColumn("analyzed", F.col("w") * F.col("e") / checked)


def analyzed_to_source(weights: DataFrame) -> DataFrame:
    """(origin, w, e) -> source share, w / e normalised; e must be positive (YD3)."""
    checked = F.when(F.col("e") > 0, F.col("e")).otherwise(F.raise_error(F.lit("yields must be positive")).cast("double"))
    return weights.withColumn("__x", F.col("w") / checked).withColumn("source", F.col("__x") / F.sum("__x").over(Window.partitionBy())).drop("__x")


def assumed_corrections(weights: DataFrame, assumed: DataFrame) -> DataFrame:
    """(origin, w), (assumption, origin, e) -> assumption, origin, source: w / e normalised under each assumption (YD7)."""
    own = weights.select("origin", "w").join(assumed.select("assumption", "origin", "e"), "origin")
    part = own.withColumn("__x", F.col("w") / F.when(F.col("e") > 0, F.col("e")).otherwise(F.raise_error(F.lit("yields must be positive")).cast("double")))
    return part.withColumn("source", F.col("__x") / F.sum("__x").over(Window.partitionBy("assumption"))).select("assumption", "origin", "source")


def gate_visibility(emissions: DataFrame, schedule: DataFrame, missing_rate: float = 0.0) -> DataFrame:
    """(origin, probe, q), (cycle, probe, gate_group) -> origin, visibility: every group shows a positive call (YD4, JN1).

    Cycles without a group take no part; a missing rate outside 0 .. 1 is an error. A cycle whose probe is unknown is
    an error too, as its group could not show.
    """
    if not 0 <= missing_rate <= 1:
        raise ValueError("missing_rate must be a probability")
    gated = schedule.filter("gate_group is not null")
    if gated.join(emissions.select("probe").distinct(), "probe", "left_anti").count():  # a row per cycle
        raise ValueError("a gated cycle has no known probe")
    miss = F.product(1 - F.col("q") * F.lit(1 - missing_rate))
    groups = emissions.join(F.broadcast(gated), "probe").groupBy("origin", "gate_group").agg((1 - miss).alias("shown"))
    return groups.groupBy("origin").agg(F.product("shown").alias("visibility"))


def empirical_yield(molecules: DataFrame) -> DataFrame:
    """(origin, accepted) -> origin, n_source, n_accepted, source, analyzed, yield: realised shares and yields (AGG21).

    source is the origin's share of all molecules, analyzed of the accepted ones (null if none is), yield the accepted share
    of the origin's own. Null acceptance counts as rejected.
    """
    found = molecules.groupBy("origin").agg(F.count("*").alias("n_source"), F.sum(F.coalesce(F.col("accepted").cast("long"), F.lit(0))).alias("n_accepted"))
    whole = Window.partitionBy()  # a row per origin
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(whole))
    return found.select("origin", "n_source", "n_accepted", share("n_source").alias("source"), share("n_accepted").alias("analyzed"), (F.col("n_accepted") / F.col("n_source")).alias("yield"))


def passes_gate(calls: Column, groups: list[list[int]]) -> Column:
    """Recorded calls have a positive one in every group (FLT9)."""
    out = F.lit(True)
    for g in groups:
        hit = F.lit(False)
        for c in g:
            hit = hit | (calls[c] == 1)
        out = out & hit
    return out
