"""Scores of assignments: distinct (class, truth) pairs with counts, weighted sums over them, nothing per molecule after the grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtide.functions.math import bind, first_argmax
from mixtide.operators.metrics import auroc, average_precision
from mixtide.session import use_checkpoints

#: The smallest positive normal double, under logarithms.
TINY = 2.2250738585072014e-308


def decoder_truth(origin: Column, kept: list[int]) -> Column:
    """Place of an origin among the decoder's, -1 where it is left out (PRJ5, JN5)."""
    place = F.array_position(F.array(*[F.lit(k) for k in kept]), origin.cast("int"))
    return F.coalesce((place - 1).cast("int"), F.lit(-1))


def class_truth_pairs(counts: DataFrame) -> DataFrame:
    """(molecule, observed, positive, truth) -> distinct (observed, positive, truth) with n (JN7)."""
    return counts.groupBy("observed", "positive", "truth").agg(F.count("*").alias("n"))


def assignment_metrics(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(post, truth, n) -> one row of proper scores and calibration (MT7). Truth -1 is left out and counted in excluded."""
    p_true, top = F.element_at("post", F.col("truth") + 1), F.array_max("post")
    square = F.aggregate("post", F.lit(0.0), lambda s, x: s + x * x)
    inside = F.col("truth") >= 0
    rows = pairs.select("n", inside.alias("inside"), F.when(inside, F.ln(F.greatest(p_true, F.lit(TINY)))).alias("log"), F.when(inside, square - 2 * p_true + 1).alias("brier"), (first_argmax(F.col("post")) == F.col("truth")).cast("double").alias("right"), top.alias("conf"))
    binned = rows.groupBy("inside", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("log", "brier", "right", "conf")])
    total = lambda c: F.sum(F.when(F.col("inside"), F.col(c)))
    gap = F.sum(F.when(F.col("inside"), F.abs(F.col("right") - F.col("conf"))))
    mean = lambda x: F.try_divide(x, total("n"))
    return binned.agg(mean(-total("log")).alias("nll"), mean(total("brier")).alias("brier"), mean(total("right")).alias("accuracy"), mean(total("conf")).alias("confidence"), mean(gap).alias("ece"), mean(total("conf") - total("right")).alias("overconfidence"), F.try_divide(total("n"), F.sum("n")).alias("coverage"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("excluded"))


def group_posteriors(pairs: DataFrame, groups: list[list[int]]) -> DataFrame:
    """(post, truth) with both in groups of origins: sums of post, and the group that has the true origin (MT7's group level).

    Groups must share out the origins; truth -1 stays.
    """
    if not groups or not all(groups) or sorted(o for g in groups for o in g) != list(range(sum(map(len, groups)))):
        raise ValueError("groups must be non-empty and share out the origins")
    of = sorted((o, k) for k, g in enumerate(groups) for o in g)
    sums = F.array(*[F.aggregate(F.array(*[F.lit(o) for o in g]), F.lit(0.0), lambda s, o: s + F.get("post", o)) for g in groups])
    place = F.when(F.col("truth") >= 0, F.get(F.array(*[F.lit(k) for _, k in of]), F.col("truth"))).otherwise(-1)
    return pairs.withColumns({"post": sums, "truth": place})


def top_k_recall(pairs: DataFrame, k: int) -> DataFrame:
    """Share of (post, truth, n) whose truth is among the k likeliest; of equals the first origins count (MT10)."""
    mine = F.element_at("post", F.col("truth") + 1)
    ahead = F.size(F.filter("post", lambda x, i: (x > mine) | ((x == mine) & (i < F.col("truth")))))
    return pairs.filter("truth >= 0").agg(F.try_divide(F.sum(F.when(ahead < k, F.col("n")).otherwise(0)), F.sum("n")).alias("recall"))


def top_1_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of (ll, truth, n) whose likeliest origin, the first of equals, is the true one (MT11)."""
    right = first_argmax(F.col("ll")) == F.col("truth")
    return pairs.filter("truth >= 0").agg(F.try_divide(F.sum(F.when(right, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))


def mean_entropy(pairs: DataFrame) -> DataFrame:
    """Mean posterior entropy in nats over pairs of known truth (MT12); terms of probability 0 add nothing."""
    entropy = F.aggregate("post", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return pairs.filter("truth >= 0").agg(F.try_divide(F.sum(F.col("n") * entropy), F.sum("n")).alias("entropy"))


def outlier_report(rows: DataFrame, accept: float = 0.8, digits: int = 9) -> DataFrame:
    """(molecule, post, ll, observed, truth) -> AUROC and AUPRC of two outlier scores, accepted outliers, mean confidences.

    MT15. AUPRC is the average precision, ties by molecule; both are null unless there are outliers and others.
    """
    calls = F.greatest(F.aggregate("observed", F.lit(0), lambda s, x: s + x), F.lit(1))
    top, likelihood = F.array_max("post"), F.round(-F.array_max("ll") / calls, digits)
    use_checkpoints(rows.sparkSession)
    narrow = rows.select(F.col("molecule").alias("id"), (F.col("truth") < 0).cast("int").alias("label"), F.round(-top, digits).alias("posterior"), likelihood.alias("likelihood"), F.round(top, digits).alias("conf"))
    kept = narrow.checkpoint()  # read by the means and twice for each score
    out, conf = F.col("label") == 1, F.col("conf")
    rest = kept.agg(F.avg(F.when(out, (conf >= accept).cast("double"))).alias("false_accept"), F.avg(F.when(out, conf)).alias("outlier_confidence"), F.avg(F.when(~out, conf)).alias("inlier_confidence"))
    for name in ("posterior", "likelihood"):
        scored = kept.select("id", F.col(name).alias("score"), "label")
        roc = auroc(scored).withColumnRenamed("auroc", f"auroc_{name}")
        prc = average_precision(scored).withColumnRenamed("ap", f"auprc_{name}")
        rest = rest.join(F.broadcast(roc), how="cross").join(F.broadcast(prc), how="cross")  # one row each
        rest = rest.withColumn(f"auprc_{name}", F.when(F.col(f"auroc_{name}").isNotNull(), F.col(f"auprc_{name}")))
    return rest


def confidence_gate(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Keep (post, n) whose largest posterior reaches least, decoded to the first largest (FLT10)."""
    return rows.filter(F.array_max("post") >= least).groupBy(first_argmax(F.col("post")).alias("origin")).agg(F.sum("n").alias("n"))


def flag_unassigned(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """(post) with origin, the first likeliest one, or -1 where its posterior stays below least: possibly of no known origin (FLT13)."""
    if not 0 <= least <= 1:
        raise ValueError("least must be a probability")
    return rows.withColumn("origin", F.when(F.array_max("post") >= least, first_argmax(F.col("post"))).otherwise(-1))


def likelihood_classes(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """(ll, n) -> ll centred by its maximum, n, log_offset: rows that differ by a constant are one class (AGG5, AGG6)."""
    centred = bind(F.array_max("ll"), lambda top: F.transform("ll", lambda x: x - top))
    centred = centred if digits is None else F.transform(centred, lambda x: F.round(x, digits))
    return scored.select(centred.alias("centred"), "n", (F.col("n") * F.array_max("ll")).alias("part")).groupBy(F.col("centred").alias("ll")).agg(F.sum("n").alias("n"), F.sum("part").alias("log_offset"))
