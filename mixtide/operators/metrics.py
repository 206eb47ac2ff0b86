"""Scores of compositions, rankings and calibrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtide.functions.ranks import running_totals


def abundance_metrics(pairs: DataFrame) -> DataFrame:
    """(est, truth) -> l1, tv, rmse, max_abs (MT1)."""
    d = F.abs(F.col("est") - F.col("truth"))
    return pairs.agg(F.sum(d).alias("l1"), (F.sum(d) / 2).alias("tv"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d).alias("max_abs"))


def jensen_shannon(pairs: DataFrame) -> DataFrame:
    """Base-2 divergence; zero terms add nothing (MT2)."""
    term = lambda x, y: F.when(x > 0, x * (1 + F.log2(x) - F.log2(x + y))).otherwise(0.0)
    return pairs.agg((F.sum(term(F.col("est"), F.col("truth")) + term(F.col("truth"), F.col("est"))) / 2).alias("js"))


def detection(pairs: DataFrame, total: float, least: float = 20.0) -> DataFrame:
    """Sensitivity and false discovery rate of total * w >= least (MT6, FLT12)."""
    called, true = F.col("est") * total >= least, F.col("truth") * total >= least
    n = lambda c: F.sum(c.cast("int"))
    return pairs.agg(n(called).cast("long").alias("called"), F.try_divide(n(called & true), n(true)).alias("sensitivity"), F.coalesce(F.try_divide(n(called & ~true), n(called)), F.lit(0.0)).alias("fdr"))


def auroc(scored: DataFrame) -> DataFrame:
    """(score, label) -> auroc with average ranks on ties (MT13). Scores are counted before they are ranked; null ones rank lowest."""
    by_score = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    ranked = running_totals(by_score, [F.col("score")], "n").withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2, p * n).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(id, score, label) -> ap; ties go by id, null scores come last (MT14)."""
    run = running_totals(scored.withColumn("one", F.lit(1)), [F.col("score").desc(), F.col("id")], "one", "label")
    precision = (F.col("before_label") + 1) / (F.col("before_one") + 1)
    return run.agg(F.try_divide(F.sum(F.when(F.col("label") == 1, precision).otherwise(0.0)), F.sum("label")).alias("ap"))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(confidence, correct) -> equal-width bins with means; empty bins have n 0 and no means (MT8)."""
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    found = scored.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def equal_frequency(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(id, confidence, correct) -> bins of equal size, the first ones one row longer (MT9)."""
    total = scored.count()
    small, longer = divmod(total, bins)
    rank = F.col("before_one")
    inside = F.when(rank < longer * (small + 1), F.floor(rank / (small + 1))).otherwise(longer + F.floor((rank - longer * (small + 1)) / max(1, small)))
    placed = running_totals(scored.withColumn("one", F.lit(1)), [F.col("confidence"), F.col("id")], "one")
    return placed.withColumn("bin", inside.cast("int")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))


def wilson(rows: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(hits, n) -> share with Wilson's interval (AGG18)."""
    p, n = F.col("hits") / F.col("n"), F.col("n")
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return rows.withColumns({"share": p, "low": centre - half, "high": centre + half})


def group_sums(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Sums of columns by the group of each origin (AGG15); labels (origin, group_id) has a row per origin."""
    return rows.join(F.broadcast(labels), "origin").groupBy("group_id").agg(*[F.sum(c).alias(c) for c in columns])


def augmented_error(pairs: DataFrame, outlier_mass: float) -> DataFrame:
    """(est, truth) over the dictionary plus one coordinate of the mass outside it, estimated 0 -> mae, rmse, max_abs (MT3, MT4)."""
    d, out = F.abs(F.col("est") - F.col("truth")), F.lit(float(outlier_mass))
    n = F.count("*") + 1
    return pairs.agg(((F.sum(d) + out) / n).alias("mae"), F.sqrt((F.sum(d * d) + out * out) / n).alias("rmse"), F.greatest(F.max(d), out).alias("max_abs"), ((F.sum(d) + out) / 2).alias("tv"))


def feature_marginals(weights: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """(origin, w...), (origin, feature, bit) -> feature and the weight of origins that have it (MT5, BS4)."""
    return weights.join(F.broadcast(features.filter("bit = 1")), "origin").groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns])


def group_errors(pairs: DataFrame, labels: DataFrame, outlier_mass: float = 0.0) -> DataFrame:
    """(origin, est, truth), (origin, group_id) -> groups, resolved, tv, origin_tv: group errors, with the mass outside the dictionary (MT4).

    The mass outside is a group of its own, estimated 0. Where a group has more than one origin, origins cannot be told
    apart: resolved is false and origin_tv null.
    """
    sums = group_sums(pairs, labels, "est", "truth")
    by_group = augmented_error(sums, outlier_mass).select("tv")
    by_origin = augmented_error(pairs, outlier_mass).select(F.col("tv").alias("origin_tv"))
    sizes = labels.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), (F.max("n") <= 1).alias("resolved"))
    out = sizes.crossJoin(F.broadcast(by_group)).crossJoin(F.broadcast(by_origin))  # one row each
    return out.select("groups", "resolved", "tv", F.when(F.col("resolved"), F.col("origin_tv")).alias("origin_tv"))


def feature_pairs(weights: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """(origin, w...), (origin, feature, bit) -> one, two and the weight of origins that have both features, one < two (MT5).

    Pairs that no origin has are there with 0. Features and origins are the panel's, so both sides of the pairing are small.
    """
    have = features.filter("bit = 1")
    both = have.select("origin", F.col("feature").alias("one")).join(F.broadcast(have.select("origin", F.col("feature").alias("two"))), "origin").filter("one < two")
    names = features.select("feature").distinct()
    every = names.select(F.col("feature").alias("one")).join(F.broadcast(names.select(F.col("feature").alias("two"))), F.col("one") < F.col("two"))
    found = weights.join(F.broadcast(both), "origin").groupBy("one", "two").agg(*[F.sum(c).alias(c) for c in columns])
    return every.join(found, ["one", "two"], "left").select("one", "two", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def feature_errors(pairs: DataFrame, kinds: DataFrame, features: DataFrame) -> DataFrame:
    """(origin, est, truth), (origin, kind), (origin, feature, bit) -> kind_tv, marginal_mae, pair_mae (MT5).

    Total variation between the kinds' totals, and the mean absolute errors of the features' and feature pairs' weights.
    """
    gap = F.abs(F.col("est") - F.col("truth"))
    totals = pairs.join(F.broadcast(kinds), "origin").groupBy("kind").agg(F.sum("est").alias("est"), F.sum("truth").alias("truth"))
    every = features.select("feature").distinct()
    alone = every.join(feature_marginals(pairs, features, "est", "truth"), "feature", "left").fillna(0.0, ["est", "truth"])
    out = totals.agg((F.sum(gap) / 2).alias("kind_tv"))
    out = out.crossJoin(F.broadcast(alone.agg(F.avg(gap).alias("marginal_mae"))))  # one row each
    return out.crossJoin(F.broadcast(feature_pairs(pairs, features, "est", "truth").agg(F.avg(gap).alias("pair_mae"))))


def percent_error(pairs: DataFrame) -> DataFrame:
    """(est, truth) -> median percent error over present origins and the mass given to absent ones (MT22)."""
    present = F.col("truth") > 0
    error = F.when(present, F.abs(F.col("est") - F.col("truth")) / F.col("truth") * 100)
    return pairs.agg(F.percentile(error, 0.5).alias("median_percent_error"), F.sum(F.when(present, 0.0).otherwise(F.col("est"))).alias("false_mass"))


def paired_differences(rows: DataFrame, one: str, two: str) -> DataFrame:
    """(pair, arm, value) -> n, mean, sd and standard error of value in arm one minus value in arm two (MT23, JN8).

    A pair without both arms takes no part; a single pair has sd 0.
    """
    by_pair = rows.groupBy("pair").agg(F.max(F.when(F.col("arm") == one, F.col("value"))).alias("x"), F.max(F.when(F.col("arm") == two, F.col("value"))).alias("y"))
    d = by_pair.filter("x is not null and y is not null").select((F.col("x") - F.col("y")).alias("d"))
    sd = F.coalesce(F.stddev_samp("d"), F.lit(0.0))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count("*"))).alias("se"))


def threshold_sweep(scored: DataFrame, support: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """Classes (n, ll) at each ratio threshold -> mean support size, share with one origin, density and share keeping the true one (MT24).

    support(t) comes from a Column over threshold; truth is the true origin's place. The thresholds are few.
    """
    table = scored.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    kept = scored.crossJoin(F.broadcast(table)).select("threshold", "n", support.alias("kept"), truth.alias("truth"))
    size = F.size(F.filter("kept", lambda x: x))
    n = F.col("n")
    share = lambda c: F.sum(F.when(c, n).otherwise(0)) / F.sum("n")
    return kept.groupBy("threshold").agg((F.sum(size * n) / F.sum("n")).alias("mean_support"), share(size == 1).alias("unique_fraction"), (F.sum(size * n) / F.sum(F.size("kept") * n)).alias("density"), share(F.get("kept", F.col("truth"))).alias("retained"))
