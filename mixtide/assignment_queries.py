"""Registered queries on assignments, outliers, groups and the bootstrap, over the orders' traces."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.functions.math import uniform
from mixtide.operators import assignment as A
from mixtide.operators import classes as C
from mixtide.operators import likelihood as L
from mixtide.operators import metrics as M
from mixtide.plans import bootstrap as B
from mixtide.plans import em as E
from mixtide.plans.conditioning import conditioning
from mixtide.queries import _COUNTS, _EM, _LL, _ORDERS, _TRUTH, _U, ITERATIONS, PROFILES, WEIGHTS, Q, order_classes, order_origins, order_traces, origins, register, truth_pairs
from mixtide.session import use_checkpoints

#: The decoder of the outlier queries leaves the last origin out.
KEPT = list(range(7))


def _labelled(spark: SparkSession, d: str, kept: list[int]) -> DataFrame:
    """Molecules with counts and the place of their origin in the decoder."""
    counts = C.probe_counts(order_traces(spark, d), 8, F.max("origin").alias("origin"))
    return counts.withColumn("truth", A.decoder_truth(F.col("origin"), kept)).drop("origin")


def _scored(rows: DataFrame, kept: list[int]) -> DataFrame:
    return L.score(rows, [Q[k] for k in kept]).withColumn("post", E.posterior(F.col("ll"), [WEIGHTS[k] for k in kept]))


def _pairs(spark: SparkSession, d: str, kept: list[int]) -> DataFrame:
    return _scored(A.class_truth_pairs(_labelled(spark, d, kept)), kept)


def _sql(kept: list[int]) -> str:
    """CTEs up to s: molecules with ll and post, truth -1 where the origin is left out."""
    at = lambda what: "[" + ", ".join(f"count(*) filter (probe = {j} and {what})" for j in range(8)) + "]"
    logs = [math.log(WEIGHTS[k]) for k in kept]
    return f"""with {_ORDERS}, c as (select molecule, case when any_value(origin) < {len(kept)} then any_value(origin) else -1 end as truth, {at('call >= 0')} as observed, {at('call = 1')} as positive from syn group by 1),
l as (select *, {_LL([Q[k] for k in kept])} as ll from c), w as (select *, list_transform(ll, lambda x, i: x + ({logs}::double[])[i]) as lw from l),
e as (select *, list_transform(lw, lambda x: exp(x - list_max(lw))) as e from w), s as (select *, list_transform(e, lambda x: x / list_sum(e)) as post from e)"""


_ALL = list(range(8))


@register("mt7_assignment_metrics", f"""{_sql(KEPT)}, r as (select truth >= 0 as inside, ln(greatest(post[truth + 1], 2.2250738585072014e-308)) as lg, list_sum(list_transform(post, lambda x: x * x)) - 2 * post[truth + 1] + 1 as brier, (list_position(post, list_max(post)) - 1 = truth)::int::double as ok, list_max(post) as conf from s),
b as (select least(floor(conf * 10), 9) as bin, abs(sum(ok) - sum(conf)) as gap from r where inside group by 1)
select round(-avg(lg), 6) as nll, round(avg(brier), 6) as brier, round(avg(ok), 6) as accuracy, round(avg(conf), 6) as confidence, round((select sum(gap) from b) / count(*), 6) as ece, round(avg(conf) - avg(ok), 6) as overconfidence, round(count(*)::double / (select count(*) from r), 6) as coverage, (select count(*) from r where not inside) as excluded from r where inside""")
def mt7(spark, d):
    out = A.assignment_metrics(_pairs(spark, d, KEPT))
    return out.select(*[F.col(c) if c == "excluded" else F.round(c, 6).alias(c) for c in out.columns])


@register("mt10_top_k_recall", f"{_sql(_ALL)}, k as (select len(list_filter(post, lambda x, i: x > post[truth + 1] or (x = post[truth + 1] and i <= truth))) as ahead from s) select round(avg((ahead < 3)::int), 6) as recall from k")
def mt10(spark, d):
    return A.top_k_recall(_pairs(spark, d, _ALL), 3).select(F.round("recall", 6).alias("recall"))


@register("mt11_top_1_accuracy", f"{_sql(_ALL)}, r as (select truth, list_transform(ll, lambda x: round(x, 9)) as ll from s) select round(avg((list_position(ll, list_max(ll)) - 1 = truth)::int), 6) as accuracy from r")
def mt11(spark, d):
    rows = _pairs(spark, d, _ALL).withColumn("ll", F.transform("ll", lambda x: F.round(x, 9)))
    return A.top_1_accuracy(rows).select(F.round("accuracy", 6).alias("accuracy"))


@register("mt12_mean_entropy", f"{_sql(_ALL)} select round(avg(list_sum(list_transform(post, lambda x: case when x > 0 then -x * ln(x) else 0 end))), 6) as entropy from s")
def mt12(spark, d):
    return A.mean_entropy(_pairs(spark, d, _ALL)).select(F.round("entropy", 6).alias("entropy"))


_AUROC = lambda e: f"(select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0)::double / (count(*) filter (y = 1) * count(*) filter (y = 0)) from (select y, rank() over (order by {e}) + (count(*) over (partition by {e}) - 1) / 2.0 as r from o))"


_AUPRC = lambda e: f"(select sum(h::double / r) filter (y = 1) / count(*) filter (y = 1) from (select y, row_number() over w as r, sum(y) over (w rows unbounded preceding) as h from o window w as (order by {e} desc, molecule)))"


@register("mt15_outlier_report", f"""{_sql(KEPT)}, o as (select molecule, (truth < 0)::int as y, round(list_max(post), 9) as conf, round(-list_max(post), 9) as a, round(-list_max(ll) / greatest(list_sum(observed), 1), 9) as b from s)
select round(avg((conf >= 0.8)::int) filter (y = 1), 6) as false_accept, round(avg(conf) filter (y = 1), 6) as outlier_confidence, round(avg(conf) filter (y = 0), 6) as inlier_confidence, round({_AUROC('a')}, 6) as auroc_posterior, round({_AUROC('b')}, 6) as auroc_likelihood,
round({_AUPRC('a')}, 6) as auprc_posterior, round({_AUPRC('b')}, 6) as auprc_likelihood from o""")
def mt15(spark, d):
    out = A.outlier_report(_scored(_labelled(spark, d, KEPT), KEPT))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("flt10_confidence_gate", f"{_sql(_ALL)} select list_position(post, list_max(post))::int - 1 as origin, count(*) as n from s where list_max(post) >= 0.9 group by 1")
def flt10(spark, d):
    rows = L.score(order_classes(spark, d), Q).withColumn("post", E.posterior(F.col("ll"), WEIGHTS))
    return A.confidence_gate(rows)


@register("agg5_likelihood_classes", f"with {_ORDERS}, {_COUNTS(8, 'syn')}, l as (select n, {_LL(Q)} as ll from classes), g as (select list_transform(ll, lambda x: round(x - list_max(ll), 6) + 0.0) as ll, sum(n) as n, sum(n * list_max(ll)) as part from l group by list_transform(ll, lambda x: round(x - list_max(ll), 6) + 0.0)) select count(*) as classes, sum(n)::bigint as n, round(sum(part), 4) as log_offset from g")
def agg5(spark, d):
    return A.likelihood_classes(L.score(order_classes(spark, d), Q), 6).agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.round(F.sum("log_offset"), 4).alias("log_offset"))


_NOISE = _U("noise", "origin || '|' || probe")


@register("prj3_perturbed_emissions", f"with {_ORDERS}, q as (select origin, probe, sum(call)::double / count(*) as q from syn where call >= 0 group by 1, 2), z as (select origin, probe, greatest(least(q, 1 - 1e-12), 1e-12) as q, {_NOISE} as u from q) select origin, probe::int as probe, round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(ln(q / (1 - q)) + 0.1 + 0.25 * (2 * u - 1)))))), 9) as q from z")
def prj3(spark, d):
    noise = 2 * uniform(7, "noise", F.col("origin").cast("string"), F.col("probe").cast("string")) - 1
    out = L.perturb(L.calibrate(order_traces(spark, d)), 0.1, 0.25, noise)
    return out.select(F.col("origin").cast("long").alias("origin"), "probe", F.round("q", 9).alias("q"))


@register("mt16_origin_overlaps", f"with {_ORDERS}, q as (select origin, probe, sum(call)::double / count(*) as q from syn where call >= 0 group by 1, 2) select x.origin as a, y.origin as b, round(sqrt(greatest(0, 1 - product(sqrt(x.q * y.q) + sqrt((1 - x.q) * (1 - y.q))))), 6) as hellinger from q x join q y on x.probe = y.probe and x.origin < y.origin group by 1, 2")
def mt16(spark, d):
    return L.overlaps(L.calibrate(order_traces(spark, d))).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("hellinger", 6).alias("hellinger"))


@register("mt3_augmented_error", f"{_EM}, {_TRUTH}, d as (select abs(est - truth) as d from pairs) select round((sum(d) + 0.05) / (count(*) + 1), 5) as mae, round(sqrt((sum(d * d) + 0.0025) / (count(*) + 1)), 5) as rmse, round(greatest(max(d), 0.05), 5) as max_abs, round((sum(d) + 0.05) / 2, 5) as tv from d")
def mt3(spark, d):
    out = M.augmented_error(truth_pairs(spark, d)[0], 0.05)
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@register("agg15_group_sums", f"{_EM} select k // 2 as group_id, round(sum(w), 5) as w from em where it = {ITERATIONS} group by 1")
def agg15(spark, d):
    w = origins(spark, E.fit(L.score(order_classes(spark, d), Q), max_iter=ITERATIONS, tol=0.0).weights, "w")
    labels = spark.createDataFrame([(k, k // 2) for k in range(8)], "origin int, group_id long")
    return M.group_sums(w, labels, "w").select("group_id", F.round("w", 5).alias("w"))


@register("mt5_feature_marginals", f"{_EM}, f as (select generate_subscripts(p, 1) - 1 as k, unnest(p) as bits from (select {PROFILES}::int[][] as p)) select feature, round(sum(w), 5) as w from (select k, w, unnest(range(8)) as feature from em where it = {ITERATIONS}) join f using (k) where bits[feature + 1] = 1 group by 1")
def mt5(spark, d):
    w = origins(spark, E.fit(L.score(order_classes(spark, d), Q), max_iter=ITERATIONS, tol=0.0).weights, "w")
    features = spark.createDataFrame([(k, j, bit) for k, row in enumerate(PROFILES) for j, bit in enumerate(row)], "origin int, feature long, bit int")
    return M.feature_marginals(w, features, "w").select("feature", F.round("w", 5).alias("w"))


@register("bs1_bootstrap_intervals")
def bs1(spark, d):
    use_checkpoints(spark)
    scored = L.score(order_classes(spark, d), Q).checkpoint()  # the fit and the draws both read it
    return B.intervals(B.bootstrap(scored, E.fit(scored).weights))


@register("bs1_hard_control")
def bs1_hard(spark, d):
    """The negative control: missing calls read as negative, every draw to its class's likeliest origin; intervals of pairs of origins."""
    traces = L.missing_as_zero(order_traces(spark, d))
    scored = L.score(C.count_classes(C.probe_counts(traces, 8)), Q)
    found = B.bootstrap(scored, np.full(8, 0.125), estimator="hard")
    return B.intervals(B.grouped(found, [[0, 1], [2, 3], [4, 5], [6, 7]]))


@register("bs4_estimands")
def bs4(spark, d):
    """Intervals of an order's status, of its price and priority, and of the larger origins."""
    use_checkpoints(spark)
    scored = L.score(order_classes(spark, d), Q).checkpoint()  # the fit and the draws both read it
    base = E.fit(scored)
    n = base.expected_counts.sum()
    kinds = spark.createDataFrame([(k, k >> 2) for k in range(8)], "origin int, kind int")
    features = spark.createDataFrame([(k, f, k >> f & 1) for k in range(8) for f in range(2)], "origin int, feature int, bit int")
    active = [k for k, w in enumerate(base.weights) if n * w >= 20]
    return B.intervals(B.estimands(B.bootstrap(scored, base.weights), kinds, features, active), by="estimand")


@register(
    "flt13_unassigned",
    f"{_sql(KEPT)}, o as (select case when list_max(post) >= 0.5 then list_position(post, list_max(post)) - 1 else -1 end as origin from s) select origin, count(*) as n from o group by 1",
)
def flt13(spark, d):
    """Orders by their assigned origin, -1 for those that no origin claims."""
    found = A.flag_unassigned(_pairs(spark, d, KEPT), 0.5)
    return found.groupBy(F.col("origin").cast("long").alias("origin")).agg(F.sum("n").alias("n"))


@register(
    "mt4_group_errors",
    f"""{_EM}, {_TRUTH}, g as (select k // 2 as g, sum(est) as est, sum(truth) as truth from (select w as est, coalesce(truth, 0) as truth, k from em left join t on em.k = t.origin where it = {ITERATIONS}) group by 1)
select count(*) as groups, false as resolved, round((sum(abs(est - truth)) + 0.05) / 2, 5) as tv, null::double as origin_tv from g""",
)
def mt4(spark, d):
    """Errors of pairs of origins, with a twentieth of the mass outside the dictionary."""
    labels = spark.createDataFrame([(k, k // 2) for k in range(8)], "origin int, group_id int")
    found = M.group_errors(truth_pairs(spark, d)[0], labels, 0.05)
    return found.select("groups", "resolved", F.round("tv", 5).alias("tv"), "origin_tv")


@register("mt17_conditioning")
def mt17(spark, d):
    found = conditioning(L.score(order_classes(spark, d), Q))
    return origins(spark, np.round(found["singular_values"], 4), "singular_value").withColumns({"rank": F.lit(found["rank"]), "condition": F.lit(found["condition"])})
