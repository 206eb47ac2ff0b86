"""Registered queries of the mixture engine over the driver's tables, with their SQL.

Fixtures: F-LINE takes orders as molecules, line numbers as probes and return flags as calls; F-ORD takes orders as
molecules, three measurements of each line as cycles and three facts of the order as its origin, over a designed panel of
8 origins; F-EVT takes user-days; F-LAB scores documents by length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtide.functions.math import cpm, expit, first_argmax, logit, logsumexp, uniform
from mixtide.operators import classes as C
from mixtide.operators import likelihood as L
from mixtide.operators import metrics as M
from mixtide.operators import selection as S
from mixtide.plans import em as E
from mixtide.sources import generators as G
from mixtide.streaming.classes import windowed_counts

PROFILES = G.designed_profiles()
Q = G.designed_q(PROFILES)
LINE_PROFILES = [[(k + 1) >> (j % 3) & 1 for j in range(7)] for k in range(5)]
LINE_Q = G.designed_q(LINE_PROFILES)
WEIGHTS = [0.30, 0.22, 0.16, 0.12, 0.08, 0.06, 0.04, 0.02]
ITERATIONS = 12
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_traces(spark: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 0).otherwise(-1)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("molecule"), (F.col("l_linenumber") - 1).cast("int").alias("probe"), call.alias("call"))


def line_classes(spark: SparkSession, d: str) -> DataFrame:
    return C.count_classes(C.probe_counts(line_traces(spark, d), 7))


def order_origins(spark: SparkSession, d: str) -> DataFrame:
    """molecule, origin: an order's status, price and priority as three bits."""
    status, price = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250_000
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    origin = 4 * status.cast("int") + 2 * price.cast("int") + urgent.cast("int")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("molecule"), origin.alias("origin"))


def order_traces(spark: SparkSession, d: str) -> DataFrame:
    """molecule, origin, cycle, probe, call: quantity, discount and tax of each line against a bound; taxes of accepted lines are missing."""
    tax = F.when(F.col("l_returnflag") == "A", -1).otherwise((F.col("l_tax") > 0.04).cast("int"))
    marks = [(F.col("l_quantity") > 25).cast("int").alias("quantity"), (F.col("l_discount") > 0.05).cast("int").alias("discount"), tax.alias("tax")]
    lines = C.meet(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("molecule"), "l_linenumber", *marks))
    met = lines.join(order_origins(spark, d), "molecule")
    kinds = met.select("molecule", "origin", "l_linenumber", F.posexplode(F.array("quantity", "discount", "tax")).alias("kind", "call"))
    cells = kinds.withColumn("cycle", (F.col("l_linenumber") - 1) * 3 + F.col("kind"))
    return cells.select("molecule", "origin", "cycle", (F.col("cycle") % 8).alias("probe"), "call")


def order_classes(spark: SparkSession, d: str) -> DataFrame:
    return C.count_classes(C.probe_counts(order_traces(spark, d), 8))


def text(*columns: str):
    return [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in columns]


def origins(spark: SparkSession, values, name: str) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"origin int, {name} double")


_LINE = "lines as (select l_orderkey as molecule, l_linenumber - 1 as probe, case l_returnflag when 'R' then 1 when 'N' then 0 else -1 end as call from lineitem)"
_LIST = lambda n, e: "[" + ", ".join(e.format(j=j) for j in range(n)) + "]"
_COUNTS = lambda n, src: f"counts as (select molecule, {_LIST(n, 'count(*) filter (probe = {j} and call >= 0)')} as observed, {_LIST(n, 'count(*) filter (probe = {j} and call = 1)')} as positive from {src} group by 1), classes as (select observed, positive, count(*) as n from counts group by 1, 2)"
_LL = lambda q: "[" + ", ".join(" + ".join(f"positive[{j + 1}] * ln({p}::double) + (observed[{j + 1}] - positive[{j + 1}]) * ln(1 - {p}::double)" for j, p in enumerate(row)) + "" for row in q) + "]"
_U = lambda what, key: f"(('0x' || substr(md5('7|{what}|' || {key}), 1, 13))::bigint / 4503599627370496.0::double)"
_ORDERS = """drawn as (select o_orderkey as molecule, 4 * (o_orderstatus = 'F')::int + 2 * (o_totalprice > 250000)::int + (o_orderpriority in ('1-URGENT', '2-HIGH'))::int as origin from orders),
kinds as (select l_orderkey as molecule, l_linenumber, generate_subscripts(c, 1) - 1 as kind, unnest(c) as call from (select *, [(l_quantity > 25)::int, (l_discount > 0.05)::int, case when l_returnflag = 'A' then -1 else (l_tax > 0.04)::int end] as c from lineitem)),
cells as (select molecule, origin, (l_linenumber - 1) * 3 + kind as cycle, call from kinds join drawn using (molecule)),
syn as (select molecule, origin, cycle, cycle % 8 as probe, call from cells)"""


@register("agg3_count_classes", f"with {_LINE}, {_COUNTS(7, 'lines')} select array_to_string(observed, ',') as observed, array_to_string(positive, ',') as positive, n from classes")
def agg3(spark, d):
    return line_classes(spark, d).select(*text("observed", "positive"), "n")


_SEEN, _HIT = "(call >= 0)::int", "(call = 1)::int"


@register(
    "agg1_trace_classes",
    f"""with {_ORDERS}, t as (select molecule,
  array_to_string({_LIST(21, f"coalesce(max(case when cycle = {{j}} then {_SEEN} end), 0)")}, ',') as mask,
  array_to_string({_LIST(21, f"coalesce(max(case when cycle = {{j}} then {_HIT} end), 0)")}, ',') as trace from syn group by 1)
select mask, trace, count(*) as n from t group by 1, 2""",
)
def agg1(spark, d):
    return C.trace_classes(order_traces(spark, d).withColumn("probe", F.col("cycle")), 21).select(*text("mask", "trace"), "n")


@register("flt1_invalid_calls", "select call, count(*) as invalid from (select l_linenumber - 3 as call from lineitem) where call not in (-1, 0, 1) group by 1")
def flt1(spark, d):
    """Line numbers read as calls: most are outside the domain."""
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("molecule"), (F.col("l_linenumber") - 3).alias("call"))
    return C.invalid_calls(calls).groupBy("call").agg(F.count("*").alias("invalid"))


@register("agg4_invariant_probes", f"with {_LINE}, {_COUNTS(7, 'lines')} select array_to_string(observed[2:], ',') as observed, array_to_string(positive[2:], ',') as positive, sum(n)::bigint as n from classes group by 1, 2")
def agg4(spark, d):
    q = [[0.5, *row[1:]] for row in [[x + 0.01 * k for x in row] for k, row in enumerate(LINE_Q)]]
    kept, _, _ = C.drop_invariant_probes(line_classes(spark, d), q)
    return kept.select(*text("observed", "positive"), "n")


@register("agg4_offset", f"with {_LINE}, {_COUNTS(7, 'lines')} select round(sum(n * observed[1] * ln(0.5::double)), 6) as log_offset from classes")
def agg4_offset(spark, d):
    q = [[0.5, *row[1:]] for row in [[x + 0.01 * k for x in row] for k, row in enumerate(LINE_Q)]]
    found = line_classes(spark, d)
    return found.agg(F.round(C.drop_invariant_probes(found, q)[2], 6).alias("log_offset"))


@register("agg10_missing_fraction", f"with {_LINE}, {_COUNTS(7, 'lines')} select round(1 - sum(list_sum(observed) * n)::double / (sum(n) * 7), 9) as missing_fraction from classes")
def agg10(spark, d):
    return C.missing_fraction(line_classes(spark, d), 7).select(F.round("missing_fraction", 9).alias("missing_fraction"))


@register("agg11_scale_audit", f"with {_LINE}, {_COUNTS(7, 'lines')} select count(*) as classes, count(*) filter (n = 1) as singletons, count(*) filter (n > 1) as repeated, sum(n) filter (n > 1)::bigint as in_repeated, sum(n - 1)::bigint as duplicates, max(n) as largest, round(sum(n)::double / count(*), 9) as compression, count(*) * 5 as dense_entries, round(quantile_cont(n::double, 0.5), 6) as q5, round(quantile_cont(n::double, 0.9), 6) as q9, round(quantile_cont(n::double, 0.95), 6) as q95, round(quantile_cont(n::double, 0.99), 6) as q99, round(quantile_cont(n::double, 0.999), 6) as q999 from classes")
def agg11(spark, d):
    out = C.scale_audit(line_classes(spark, d), 5)
    return out.select(*[F.round(c, 6 if c[0] == "q" else 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@register("agg9_expand", f"with {_LINE}, {_COUNTS(7, 'lines')} select list_sum(observed)::int as calls, sum(n)::bigint as molecules from classes group by 1")
def agg9(spark, d):
    return C.expand(line_classes(spark, d)).groupBy(F.aggregate("observed", F.lit(0), lambda s, x: s + x).alias("calls")).agg(F.count("*").alias("molecules"))


@register("ll2_class_scores", f"with {_LINE}, {_COUNTS(7, 'lines')}, s as (select observed, positive, {_LL(LINE_Q)} as ll from classes) select array_to_string(observed, ',') as observed, array_to_string(positive, ',') as positive, origin, case when v = 0 then 0.0::double else round(v, 6) end as loglik from (select observed, positive, generate_subscripts(ll, 1) - 1 as origin, unnest(ll) as v from s)")
def ll2(spark, d):
    scored = L.score(line_classes(spark, d), LINE_Q)
    return scored.select(*text("observed", "positive"), F.posexplode("ll").alias("origin", "x")).select("observed", "positive", F.col("origin").cast("long").alias("origin"), F.round("x", 6).alias("loglik"))


@register("ll4_logsumexp", f"with {_LINE}, {_COUNTS(7, 'lines')}, s as (select n, {_LL(LINE_Q)} as ll from classes) select round(sum(n * (list_max(ll) + ln(list_sum(list_transform(ll, lambda x: exp(x - list_max(ll)))))))::double, 4) as total from s")
def ll4(spark, d):
    return L.score(line_classes(spark, d), LINE_Q).agg(F.round(F.sum(F.col("n") * logsumexp(F.col("ll"))), 4).alias("total"))


@register("prj2_calibration", f"with {_ORDERS} select origin, probe::int as probe, round(sum(call)::double / count(*), 9) as q from syn where call >= 0 group by 1, 2")
def prj2(spark, d):
    return L.calibrate(order_traces(spark, d)).select(F.col("origin").cast("long").alias("origin"), "probe", F.round("q", 9).alias("q"))


@register("prj6_logit_round_trip", "select l_orderkey, l_linenumber, round(1 / (1 + exp(-(ln(p) - ln(1 - p)))), 9) as p from (select l_orderkey, l_linenumber, greatest(least(l_discount::double + 0.01, 0.99), 0.01) as p from lineitem)")
def prj6(spark, d):
    p = F.greatest(F.least(F.col("l_discount").cast("double") + 0.01, F.lit(0.99)), F.lit(0.01))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(expit(logit(p)), 9).alias("p"))


_EM = f"""with recursive {_ORDERS}, {_COUNTS(8, "syn")}, s as (select row_number() over () as c, n, {_LL(Q)} as ll from classes),
l as (select c, n, generate_subscripts(ll, 1) - 1 as k, unnest(list_transform(ll, lambda x: exp(x - list_max(ll)))) as p from s),
em(it, k, w) as (select 0, k, 1.0::double / 8 from (select unnest(range(8)) as k)
  union all select it + 1, k, sum(g) / (select sum(n) from classes) from (select it, l.k, l.n * l.p * w / sum(l.p * w) over (partition by l.c) as g from l join em on l.k = em.k where it < {ITERATIONS}) group by it, k)"""


@register("em5_flagship", f"{_EM} select k as origin, round(w, 6) as weight from em where it = {ITERATIONS}")
def em5(spark, d):
    found = E.fit(L.score(order_classes(spark, d), Q), max_iter=ITERATIONS, tol=0.0)
    return origins(spark, found.weights, "weight").select(F.col("origin").cast("long").alias("origin"), F.round("weight", 6).alias("weight"))


@register("em3_converged_fit")
def em3(spark, d):
    found = E.fit(L.score(order_classes(spark, d), Q))
    return origins(spark, found.weights, "weight").withColumns({"cpm": cpm(F.col("weight")), "converged": F.lit(found.converged)})


@register("em7_hard_counts", f"with {_ORDERS}, {_COUNTS(8, 'syn')}, s as (select n, list_transform({_LL(Q)}, lambda x: round(x, 9)) as ll from classes), x as (select n, ll, generate_subscripts(ll, 1) - 1 as origin, unnest(ll) as v from s) select origin, round(sum(n::double / len(list_filter(ll, lambda y: y = list_max(ll)))), 6) as hard from x where v = list_max(ll) group by 1")
def em7(spark, d):
    scored = L.score(order_classes(spark, d), Q).withColumn("ll", F.transform("ll", lambda x: F.round(x, 9)))
    return E.hard_counts(scored).select(F.col("origin").cast("long").alias("origin"), F.round("count", 6).alias("hard"))


@register("em8_soft_counts", f"with {_ORDERS}, {_COUNTS(8, 'syn')}, s as (select n, list_transform({_LL(Q)}, lambda x: x) as ll from classes), y as (select n, list_transform(ll, lambda x: exp(x - list_max(ll))) as p from s), x as (select n, list_sum(p) as t, generate_subscripts(p, 1) - 1 as origin, unnest(p) as v from y) select origin, round(sum(n * v / t), 5) as soft from x group by 1")
def em8(spark, d):
    return E.soft_counts(L.score(order_classes(spark, d), Q), 8).select(F.col("origin").cast("long").alias("origin"), F.round("count", 5).alias("soft"))


@register("em6_posteriors", f"""with {_LINE}, {_COUNTS(7, 'lines')}, s as (select molecule, {_LL(LINE_Q)} as ll from counts),
w as (select molecule, list_transform(range(1, 6), lambda k: ll[k] + ln(({WEIGHTS[:5]}::double[])[k])) as x from s),
p as (select molecule, list_transform(x, lambda y: exp(y - list_max(x))) as e from w)
select molecule, round(list_max(e) / list_sum(e), 6) as confidence from p""")
def em6(spark, d):
    """Each distinct class is scored once; orders get their class's posterior."""
    post = L.score_observations(C.probe_counts(line_traces(spark, d), 7), LINE_Q, "observed", "positive")
    return post.select("molecule", F.round(F.array_max(E.posterior(F.col("ll"), WEIGHTS[:5])), 6).alias("confidence"))


_MISS = "[" + ", ".join("(" + " + ".join(f"observed[{j + 1}] - positive[{j + 1}]" if bit else f"positive[{j + 1}]" for j, bit in enumerate(row)) + ")" for row in PROFILES) + "]"


@register("flt6_best_compatible", f"with {_ORDERS}, {_COUNTS(8, 'syn')}, s as (select n, {_MISS} as m from classes), x as (select n, list_min(m) as least, len(list_filter(m, lambda y: y = list_min(m))) as origins from s) select least::int as least, origins::int as origins, sum(n)::bigint as n from x group by 1, 2")
def flt6(spark, d):
    found = L.best_compatible(order_classes(spark, d), PROFILES).withColumn("m", L.mismatches(PROFILES))
    return found.groupBy(F.array_min("m").alias("least"), F.size(F.filter("ll", lambda x: x == 0)).alias("origins")).agg(F.sum("n").alias("n"))


@register("flt8_ratio_support", f"with {_ORDERS}, {_COUNTS(8, 'syn')}, s as (select n, {_LL(Q)} as ll from classes) select len(list_filter(ll, lambda x: x - list_max(ll) >= ln(0.1::double)))::int as support, sum(n)::bigint as n from s group by 1")
def flt8(spark, d):
    kept = L.ratio_compatible(F.col("ll"), 0.1)
    return L.score(order_classes(spark, d), Q).groupBy(F.size(F.filter(kept, lambda x: x)).alias("support")).agg(F.sum("n").alias("n"))


@register("agg16_observable_groups", f"with {_LINE}, seen as (select list(distinct probe order by probe) as probes from lines where call >= 0), q as (select generate_subscripts(q, 1) - 1 as origin, unnest(q) as row from (select {LINE_Q}::double[][] as q)), g as (select list_transform(probes, lambda j: row[j + 1]) as key, list(origin order by origin) as members from q, seen group by 1) select row_number() over (order by members[1]) - 1 as group_id, array_to_string(members, ',') as members from g")
def agg16(spark, d):
    seen = [r["probe"] for r in line_traces(spark, d).filter("call >= 0").select("probe").distinct().orderBy("probe").collect()]  # probes, not molecules
    rows = spark.createDataFrame(list(enumerate(LINE_Q)), "origin int, q array<double>")
    return C.observable_groups(rows, seen).select(F.col("group_id").cast("long").alias("group_id"), *text("members"))


_FLAGS = "select l_returnflag as origin, count(*)::double / sum(count(*)) over () as w, avg(l_discount::double) + 0.1 as e from lineitem group by 1"


def flag_weights(spark, d):
    total = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("origin")).agg(F.count("*").alias("n"), (F.avg(F.col("l_discount").cast("double")) + 0.1).alias("e"))
    from pyspark.sql import Window

    return total.select("origin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("w"), "e")


@register("yd2_source_to_analyzed", f"select origin, round(w * e / sum(w * e) over (), 9) as analyzed from ({_FLAGS})")
def yd2(spark, d):
    return S.source_to_analyzed(flag_weights(spark, d)).select("origin", F.round("analyzed", 9).alias("analyzed"))


@register("yd3_analyzed_to_source", f"select origin, round(w / e / sum(w / e) over (), 9) as source from ({_FLAGS})")
def yd3(spark, d):
    return S.analyzed_to_source(flag_weights(spark, d)).select("origin", F.round("source", 9).alias("source"))


@register("yd4_gate_visibility", f"with {_ORDERS}, q as (select origin, probe, sum(call)::double / count(*) as q from syn where call >= 0 group by 1, 2), g as (select origin, probe // 4 as gate, 1 - product(1 - q * 0.98) as shown from q group by 1, 2) select origin, round(product(shown), 9) as visibility from g group by 1")
def yd4(spark, d):
    q = L.calibrate(order_traces(spark, d))
    schedule = spark.createDataFrame([(j, j, j // 4) for j in range(8)], "cycle int, probe int, gate_group int")
    return S.gate_visibility(q, schedule, 0.02).select(F.col("origin").cast("long").alias("origin"), F.round("visibility", 9).alias("visibility"))


@register("flt9_gate", f"with {_ORDERS}, p as (select molecule, any_value(origin) as origin, bool_or(call = 1 and probe < 4) and bool_or(call = 1 and probe >= 4) as accepted from syn group by 1) select origin, count(*) as source, count(*) filter (accepted) as accepted from p group by 1")
def flt9(spark, d):
    calls = order_traces(spark, d).groupBy("molecule", "origin").agg(F.array(*[F.max(F.when(F.col("probe") == j, F.col("call"))) for j in range(8)]).alias("calls"))
    kept = calls.withColumn("ok", S.passes_gate(F.col("calls"), [[0, 1, 2, 3], [4, 5, 6, 7]]))
    return kept.groupBy(F.col("origin").cast("long").alias("origin")).agg(F.count("*").alias("source"), F.sum(F.col("ok").cast("long")).alias("accepted"))


_TRUTH = f"t as (select origin, count(*)::double / sum(count(*)) over () as truth from drawn group by 1), pairs as (select w as est, coalesce(truth, 0) as truth from em left join t on em.k = t.origin where it = {ITERATIONS})"


def truth_pairs(spark, d):
    drawn = order_origins(spark, d)
    n = drawn.count()
    truth = drawn.groupBy("origin").agg((F.count("*") / n).alias("truth"))
    est = origins(spark, E.fit(L.score(order_classes(spark, d), Q), max_iter=ITERATIONS, tol=0.0).weights, "est")
    return est.join(truth, "origin", "left").fillna(0.0), n


@register("mt1_abundance_metrics", f"{_EM}, {_TRUTH} select round(sum(abs(est - truth)), 5) as l1, round(sum(abs(est - truth)) / 2, 5) as tv, round(sqrt(avg((est - truth) ** 2)), 5) as rmse, round(max(abs(est - truth)), 5) as max_abs from pairs")
def mt1(spark, d):
    out = M.abundance_metrics(truth_pairs(spark, d)[0])
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@register("mt2_jensen_shannon", f"{_EM}, {_TRUTH} select round(sum(case when est > 0 then est * (1 + log2(est) - log2(est + truth)) else 0 end + case when truth > 0 then truth * (1 + log2(truth) - log2(est + truth)) else 0 end) / 2, 5) as js from pairs")
def mt2(spark, d):
    return M.jensen_shannon(truth_pairs(spark, d)[0]).select(F.round("js", 5).alias("js"))


@register("mt6_detection", f"{_EM}, {_TRUTH}, c as (select est * (select count(*) from orders) >= 20 as called, truth * (select count(*) from orders) >= 20 as present from pairs) select count(*) filter (called) as called, count(*) filter (called and present)::double / count(*) filter (present) as sensitivity, coalesce(count(*) filter (called and not present)::double / nullif(count(*) filter (called), 0), 0) as fdr from c")
def mt6(spark, d):
    pairs, n = truth_pairs(spark, d)
    return M.detection(pairs, n)


_PRIOR = """p as (select dense_rank() over (order by o_orderpriority) - 1 as origin, count(*)::double as w from orders group by o_orderpriority),
cut as (select origin, sum(w) over (order by origin) / sum(w) over () as high from p)"""


@register(
    "jn9_inverse_cdf",
    f"""with {_PRIOR}, u as (select o_orderkey as molecule, {_U("identity", "o_orderkey")} as u from orders)
select molecule, (select count(*) from cut where high <= u and origin < (select max(origin) from cut)) as origin from u""",
)
def jn9(spark, d):
    """An origin for each order, drawn with the shares of the orders' priorities."""
    place = (F.dense_rank().over(Window.orderBy("o_orderpriority")) - 1).cast("long")  # a row per priority
    shares = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("w")).select(place.alias("origin"), "w")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("molecule"))
    return G.inverse_cdf(orders, uniform(7, "identity", F.col("molecule").cast("string")), shares)


def lab(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "score", F.col("quality").cast("int").alias("label"))


_LAB = "lab as (select doc_id as id, n_chars::double as score, quality::int as label from documents join labels using (doc_id))"


@register("mt13_auroc", f"with {_LAB}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from lab) select round((sum(r) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0)::double / (count(*) filter (label = 1) * count(*) filter (label = 0)), 9) as auroc from r")
def mt13(spark, d):
    return M.auroc(lab(spark, d)).select(F.round("auroc", 9).alias("auroc"))


@register("mt14_average_precision", f"with {_LAB}, r as (select label, row_number() over (order by score desc, id) as r, sum(label) over (order by score desc, id rows unbounded preceding) as h from lab) select round(sum(case when label = 1 then h::double / r else 0 end) / sum(label), 9) as ap from r")
def mt14(spark, d):
    return M.average_precision(lab(spark, d)).select(F.round("ap", 9).alias("ap"))


def confident(spark, d):
    return lab(spark, d).select("id", (F.col("score") % 1000 / 1000).alias("confidence"), F.col("label").cast("double").alias("correct"))


_CONF = f"with {_LAB}, conf as (select id, score % 1000 / 1000 as confidence, label::double as correct from lab)"


@register("mt8_reliability", f"""{_CONF}, b as (select least(floor(confidence * 10), 9)::int as bin, confidence, correct from conf)
select r.bin::int as bin, count(b.bin) as n, round(avg(confidence), 9) as confidence, round(avg(correct), 9) as accuracy
from (select unnest(range(10)) as bin) r left join b on b.bin = r.bin group by 1""")
def mt8(spark, d):
    return M.reliability(confident(spark, d)).select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


@register("mt9_equal_frequency", f"{_CONF}, b as (select *, (ntile(10) over (order by confidence, id) - 1)::int as bin from conf) select bin, count(*) as n, round(avg(confidence), 9) as confidence, round(avg(correct), 9) as accuracy from b group by 1")
def mt9(spark, d):
    return M.equal_frequency(confident(spark, d)).select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


@register("agg18_wilson", "with h as (select l_linestatus as mode, count(*) filter (l_returnflag = 'R') as hits, count(*) as n from lineitem group by 1), s as (select mode, hits::double / n as p, n::double as n, 1.959963984540054::double as z from h) select mode, round(p, 9) as share, round((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 9) as low, round((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 9) as high from s")
def agg18(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("mode")).agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("hits"), F.count("*").cast("double").alias("n"))
    return M.wilson(rows).select("mode", *[F.round(c, 9).alias(c) for c in ("share", "low", "high")])


@register("agg17_summary", "select o_orderpriority as method, round(avg(o_totalprice::double), 4) as mean, round(stddev_samp(o_totalprice::double), 4) as sd, round(quantile_cont(o_totalprice::double, 0.5), 4) as median, count(*) as n from orders group by 1")
def agg17(spark, d):
    x = F.col("o_totalprice").cast("double")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4).alias("sd"), F.round(F.percentile(x, 0.5), 4).alias("median"), F.count("*").alias("n"))


@register("stream_class_counts", "select date_trunc('day', ts) as window_start, event_type, count(value) as observed, count(*) filter (value > 50) as positive from events group by 1, 2")
def stream(spark, d):
    return windowed_counts(table(spark, d, "events"))


_TRACES = f"traces as (select molecule, {_LIST(7, 'coalesce(max(case when probe = {j} then (call >= 0)::int end), 0)')} as mask, {_LIST(7, 'coalesce(max(case when probe = {j} then (call = 1)::int end), 0)')} as trace from lines group by 1)"


@register("ll1_trace_scores", f"""with {_LINE}, {_TRACES}, c as (select mask as observed, trace as positive, count(*) as n from traces group by 1, 2),
s as (select observed, positive, n, {_LL(LINE_Q)} as ll from c)
select array_to_string(observed, ',') as mask, array_to_string(positive, ',') as trace, n, origin, round(v, 6) + 0.0 as loglik
from (select observed, positive, n, generate_subscripts(ll, 1) - 1 as origin, unnest(ll) as v from s)""")
def ll1(spark, d):
    scored = L.score_traces(C.trace_classes(line_traces(spark, d), 7), LINE_Q)
    cells = scored.select(*text("mask", "trace"), "n", F.posexplode("ll").alias("origin", "x"))
    return cells.select("mask", "trace", "n", F.col("origin").cast("long").alias("origin"), (F.round("x", 6) + 0.0).alias("loglik"))


@register("ll3_observation_scores", f"""with {_LINE}, {_COUNTS(7, 'lines')}, s as (select molecule, {_LL(LINE_Q)} as ll from counts)
select molecule, round(list_max(ll), 6) + 0.0 as best, round(list_sum(ll), 6) + 0.0 as total from s""")
def ll3(spark, d):
    scored = L.score_observations(C.probe_counts(line_traces(spark, d), 7), LINE_Q, "observed", "positive")
    total = F.aggregate("ll", F.lit(0.0), lambda s, x: s + x)
    return scored.select("molecule", (F.round(F.array_max("ll"), 6) + 0.0).alias("best"), (F.round(total, 6) + 0.0).alias("total"))


def panel_traces(spark, d):
    """Orders over the panel's twelve probes: part keys deal lines to probes, return flags are calls."""
    call = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 0).otherwise(-1)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("molecule"), ((F.col("l_partkey") + F.col("l_linenumber")) % 12).cast("int").alias("probe"), call.alias("call"))


_PANEL = f"""plines as (select l_orderkey as molecule, (l_partkey + l_linenumber) % 12 as probe, case l_returnflag when 'R' then 1 when 'N' then 0 else -1 end as call from lineitem),
bits as (select o as origin, [1, 1, (o // 128 < 2)::int, (o // 128 >= 4)::int, (o // 128 % 2)::int, o // 64 % 2, o // 32 % 2, o // 16 % 2, o // 8 % 2, o // 4 % 2, o // 2 % 2, o % 2] as b from (select unnest(range(768)) as o)),
logs as (select origin, list_transform(range(1, 13), lambda j: ln(case when b[j] = 1 then ({G.ALPHA}::double[])[j] else ({G.BETA}::double[])[j] end)) as yes,
  list_transform(range(1, 13), lambda j: ln(1 - case when b[j] = 1 then ({G.ALPHA}::double[])[j] else ({G.BETA}::double[])[j] end)) as no from bits)"""


@register("ll2_panel_scores", f"""with {_PANEL}, {_COUNTS(12, "plines")},
s as (select observed, positive, n, {" + ".join(f"positive[{j}] * yes[{j}] + (observed[{j}] - positive[{j}]) * no[{j}]" for j in range(1, 13))} as v from classes, logs)
select array_to_string(observed, ',') as observed, array_to_string(positive, ',') as positive, any_value(n) as n, round(max(v), 5) + 0.0 as best, round(min(v), 5) + 0.0 as worst from s group by 1, 2""")
def ll2_panel(spark, d):
    """All 768 candidates of the panel against the classes of all orders."""
    scored = L.score(C.count_classes(C.probe_counts(panel_traces(spark, d), 12)), G.panel_q(spark))
    return scored.select(*text("observed", "positive"), "n", (F.round(F.array_max("ll"), 5) + 0.0).alias("best"), (F.round(F.array_min("ll"), 5) + 0.0).alias("worst"))


@register("em5_panel_fit")
def em5_panel(spark, d):
    """fit_em over the panel, to convergence: 768 origins, 12 probes, all orders."""
    found = E.fit_em(panel_traces(spark, d), G.panel_q(spark), max_iter=300, tol=1e-4)
    weights = origins(spark, found.weights, "weight")
    return G.panel(spark).join(weights, "origin").select("origin", "candidate_id", F.round("weight", 9).alias("weight"), cpm(F.col("weight")).alias("cpm"))


@register("em5_fit_lines", f"""with recursive {_LINE}, {_COUNTS(7, "lines")}, s as (select row_number() over () as c, n, {_LL(LINE_Q)} as ll from classes),
l as (select c, n, generate_subscripts(ll, 1) - 1 as k, unnest(list_transform(ll, lambda x: exp(x - list_max(ll)))) as p from s),
em(it, k, w) as (select 0, k, 1.0::double / 5 from (select unnest(range(5)) as k)
  union all select it + 1, k, sum(g) / (select sum(n) from classes) from (select it, l.k, l.n * l.p * w / sum(l.p * w) over (partition by l.c) as g from l join em on l.k = em.k where it < {ITERATIONS}) group by it, k)
select k as origin, round(w, 6) as weight from em where it = {ITERATIONS}""")
def em5_lines(spark, d):
    """fit_em over lines with a schedule; an order without a call is flat and leaves the weights as they are."""
    schedule = spark.createDataFrame([(c, c) for c in range(7)], "cycle int, probe int")
    traces = line_traces(spark, d).withColumnRenamed("probe", "cycle").withColumn("call", F.when(F.col("call") == -1, F.lit(0)).otherwise(F.col("call")))
    found = E.fit_em(traces, LINE_Q, schedule, max_iter=ITERATIONS, tol=0.0)
    return origins(spark, found.weights, "weight").select(F.col("origin").cast("long").alias("origin"), F.round("weight", 6).alias("weight"))


ORACLE["em5_fit_lines"] = ORACLE["em5_fit_lines"].replace("when 'N' then 0 else -1 end", "else 0 end")


@register("mt20_cumulative_posteriors", f"""with {_LINE}, q as (select generate_subscripts(x, 1) - 1 as origin, unnest(x) as row from (select {LINE_Q}::double[][] as x)),
c as (select molecule, probe as cycle, origin, sum(case call when 1 then ln(row[probe + 1]) when 0 then ln(1 - row[probe + 1]) else 0 end) as part from lines, q group by 1, 2, 3),
s as (select molecule, cycle, origin, sum(part) over (partition by molecule, origin order by cycle) as ll from c),
e as (select *, exp(ll - max(ll) over (partition by molecule, cycle)) as e from s)
select molecule, cycle, origin, round(e / sum(e) over (partition by molecule, cycle), 9) as posterior from e""")
def mt20(spark, d):
    cells = line_traces(spark, d).withColumn("cycle", F.col("probe").cast("long"))
    found = L.cumulative_posteriors(cells, LINE_Q).select("molecule", "cycle", F.posexplode("posterior").alias("origin", "p"))
    return found.select("molecule", "cycle", F.col("origin").cast("long").alias("origin"), F.round("p", 9).alias("posterior"))


_PRIORITY = "select count(*) filter (o_orderstatus = 'F')::double / sum(count(*) filter (o_orderstatus = 'F')) over () as truth, sum(o_totalprice::double) / sum(sum(o_totalprice::double)) over () as est from orders group by o_orderpriority, o_orderstatus"


@register("mt22_percent_error", f"""with p as ({_PRIORITY}) select round(quantile_cont(abs(est - truth) / truth * 100, 0.5) filter (truth > 0), 6) as median_percent_error,
round(sum(case when truth > 0 then 0 else est end), 9) as false_mass from p""")
def mt22(spark, d):
    """Groups of finished orders are present, the others absent; estimates are shares of the money."""
    from pyspark.sql import Window

    whole = Window.partitionBy()  # a row per priority and status
    shares = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("f"), F.sum(F.col("o_totalprice").cast("double")).alias("m"))
    found = M.percent_error(shares.select((F.col("f") / F.sum("f").over(whole)).alias("truth"), (F.col("m") / F.sum("m").over(whole)).alias("est")))
    return found.select(F.round("median_percent_error", 6).alias("median_percent_error"), F.round("false_mass", 9).alias("false_mass"))


@register("mt23_paired_differences", """with p as (select l_orderkey, max(l_discount::double) filter (l_linestatus = 'F' and l_returnflag = 'R') as x, max(l_discount::double) filter (l_linestatus = 'F' and l_returnflag = 'A') as y from lineitem group by 1),
d as (select x - y as d from p where x is not null and y is not null)
select count(*) as n, round(avg(d), 9) as mean, round(coalesce(stddev_samp(d), 0), 9) as sd, round(coalesce(stddev_samp(d), 0) / sqrt(count(*)), 9) as se from d""")
def mt23(spark, d):
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("pair"), F.col("l_returnflag").alias("arm"), F.col("l_discount").cast("double").alias("value"))
    return M.paired_differences(rows, "R", "A").select("n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "se")])


@register("mt24_threshold_sweep", f"""with {_LINE}, {_COUNTS(7, 'lines')}, s as (select n, list_sum(observed) % 5 as truth, {_LL(LINE_Q)} as ll from classes),
k as (select t as threshold, n, truth, list_transform(ll, lambda x: x - list_max(ll) >= ln(t) - 1e-9) as kept from s, (select unnest([0.01, 0.1, 0.5]::double[]) as t)),
m as (select *, len(list_filter(kept, lambda x: x)) as size from k)
select threshold, round(sum(size * n)::double / sum(n), 9) as mean_support, round(sum(case when size = 1 then n else 0 end)::double / sum(n), 9) as unique_fraction,
round(sum(size * n)::double / sum(5 * n), 9) as density, round(sum(case when kept[truth::int + 1] then n else 0 end)::double / sum(n), 9) as retained from m group by 1""")
def mt24(spark, d):
    from mixtide.functions.math import bind

    kept = bind(F.array_max("ll"), lambda top: F.transform("ll", lambda x: x - top >= F.ln("threshold") - 1e-9))
    truth = (F.aggregate("observed", F.lit(0), lambda s, x: s + x) % 5).cast("int")
    found = M.threshold_sweep(L.score(line_classes(spark, d), LINE_Q), kept, truth, [0.01, 0.1, 0.5])
    return found.select("threshold", *[F.round(c, 9).alias(c) for c in ("mean_support", "unique_fraction", "density", "retained")])


@register("yd7_assumed_corrections", f"""with f as ({_FLAGS}), a as (select 'oracle' as assumption, origin, w, e from f union all select 'equal', origin, w, 1.0 from f)
select assumption, origin, round(w / e / sum(w / e) over (partition by assumption), 9) as source from a""")
def yd7(spark, d):
    own = flag_weights(spark, d)
    assumed = own.select(F.lit("oracle").alias("assumption"), "origin", "e").unionByName(own.select(F.lit("equal").alias("assumption"), "origin", F.lit(1.0).alias("e")))
    return S.assumed_corrections(own, assumed).withColumn("source", F.round("source", 9))


@register("prj7_missing_as_zero", f"with {_LINE} select greatest(call, 0) as call, count(*) as n from lines group by 1")
def prj7(spark, d):
    return L.missing_as_zero(line_traces(spark, d)).groupBy("call").agg(F.count("*").alias("n"))
