"""Registered queries on class membership, repeats, sensitivity, gates and features, over the tables, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.assignment_queries import _pairs as assignment_pairs
from mixtide.assignment_queries import _sql as assignment_sql
from mixtide.functions.math import cpm, first_argmax
from mixtide.operators import assignment as A
from mixtide.operators import classes as C
from mixtide.operators import evidence as V
from mixtide.operators import likelihood as L
from mixtide.operators import membership as N
from mixtide.operators import metrics as M
from mixtide.operators import repeats as R
from mixtide.operators import selection as S
from mixtide.plans import bootstrap as B
from mixtide.plans import em as E
from mixtide.plans import panels as P
from mixtide.plans.conditioning import close_groups, origin_products, score_gram
from mixtide.queries import (
    _COUNTS,
    _LINE,
    _LL,
    _ORDERS,
    _PANEL,
    ITERATIONS,
    LINE_Q,
    PROFILES,
    WEIGHTS,
    Q,
    line_classes,
    line_traces,
    order_classes,
    order_origins,
    order_traces,
    panel_traces,
    register,
    table,
    text,
)
from mixtide.session import shared_folder
from mixtide.sources import generators as G
from mixtide.streaming.refit import fits, refit_stream

SIGMA = 0.8
_Z, _W = (x.tolist() for x in R.quadrature())
_B = R.marginal_intercepts(np.array(LINE_Q), SIGMA).tolist()


@register(
    "agg8_repeat_aware",
    f"""with {_LINE}, {_COUNTS(7, "lines")}, cls as (select row_number() over () as c, observed, positive from classes),
cell as (select c, generate_subscripts(observed, 1) as probe, unnest(observed) as o, unnest(positive) as h from cls),
need as (select distinct probe, o, h from cell),
node as (select unnest(range(1, 65)) as i), origins as (select unnest(range(5)) as origin),
chance as (select origin, j as probe, i, 1 / (1 + exp(-(({_B}::double[][])[origin + 1][j] + {SIGMA} * ({_Z}::double[])[i]))) as p from origins, node, (select unnest(range(1, 8)) as j)),
tab as (select origin, probe, o, h, ln(sum(({_W}::double[])[i] * pow(p, h) * pow(1 - p, o - h))) as lg from need join chance using (probe) group by all),
s as (select c, origin, sum(lg) as ll from cell join tab using (probe, o, h) group by all)
select array_to_string(observed, ',') as observed, array_to_string(positive, ',') as positive, origin, round(ll, 6) + 0.0 as loglik from s join cls using (c)""",
)
def agg8(spark: SparkSession, d: str) -> DataFrame:
    """Line classes where the calls of one probe share an effect."""
    scored = R.score_repeat_aware(line_classes(spark, d), LINE_Q, SIGMA)
    rows = scored.select(*text("observed", "positive"), F.posexplode("ll").alias("origin", "x"))
    return rows.select("observed", "positive", F.col("origin").cast("long").alias("origin"), (F.round("x", 6) + 0.0).alias("loglik"))


@register(
    "em14_objective",
    f"""with {_LINE}, {_COUNTS(7, "lines")}, s as (select n, {_LL(LINE_Q)} as ll from classes)
select round(sum(n * ln(list_sum(list_transform(ll, lambda x, k: exp(x) * ({WEIGHTS[:5]}::double[])[k] / {sum(WEIGHTS[:5])}::double)))), 5) as objective from s""",
)
def em14(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of the line classes under given weights."""
    found = E.objective(L.score(line_classes(spark, d), LINE_Q), WEIGHTS[:5])
    return spark.createDataFrame([(round(found, 5),)], "objective double")


_CENTRED = "list_transform(ll, lambda x: round(x - list_max(ll), 9) + 0.0)"


@register(
    "jn4_membership",
    f"""with {_LINE}, {_COUNTS(7, "lines")},
s as (select dense_rank() over (order by observed, positive) - 1 as count_class, observed, positive, {_LL(LINE_Q)} as ll from classes),
g as (select *, dense_rank() over (order by {_CENTRED}) - 1 as likelihood_class, list_max(ll) as log_offset from s)
select molecule, count_class, likelihood_class, round(log_offset, 6) + 0.0 as log_offset from counts join g using (observed, positive)""",
)
def jn4(spark: SparkSession, d: str) -> DataFrame:
    """Every order's count class and likelihood class."""
    found = N.membership(C.probe_counts(line_traces(spark, d), 7), LINE_Q)
    return found.withColumn("log_offset", F.round("log_offset", 6) + 0.0)


@register(
    "agg7_binary_classes",
    f"""with {_PANEL}, {_COUNTS(12, "plines")},
m as (select row_number() over () as c, n, observed, positive from classes),
w as (select c, n, origin, list_sum(list_transform(range(1, 13), lambda j: case when b[j] = 1 then observed[j] - positive[j] else positive[j] end)) as wrong from m, bits),
t as (select c, any_value(n) as n, list(origin order by origin) as fits from (select *, min(wrong) over (partition by c) as best from w) where wrong = best group by c)
select len(fits) as origins, fits[1] as first, list_sum(fits)::bigint as total, sum(n)::bigint as n, count(*) as members from t group by fits""",
)
def agg7(spark: SparkSession, d: str) -> DataFrame:
    """Orders' classes over the panel by the candidates that they leave possible."""
    profiles = [list(r["profile"]) for r in G.panel(spark).orderBy("origin").select("profile").collect()]  # 768 rows
    found = N.binary_classes(C.count_classes(C.probe_counts(panel_traces(spark, d), 12)), profiles)
    fits = found.withColumn("fits", N.origins_in(F.col("compatible"), len(profiles)))
    total = F.aggregate("fits", F.lit(0).cast("long"), lambda s, x: s + x)
    return fits.select(F.size("fits").cast("long").alias("origins"), F.get("fits", F.lit(0)).cast("long").alias("first"), total.alias("total"), "n", "members")


@register(
    "agg11_representations",
    f"""with {_LINE}, {_COUNTS(7, "lines")},
t as (select {"[" + ", ".join(f"coalesce(max(case when probe = {j} then call + 1 end), 0)" for j in range(7)) + "]"} as trace from lines group by molecule),
a as (select 'trace' as kind, count(*) as n from t group by trace),
b as (select 'counts' as kind, n from classes),
s as (select n, {_LL(LINE_Q)} as ll from classes), c as (select 'likelihood' as kind, sum(n)::bigint as n from s group by {_CENTRED})
select kind, count(*) as classes, count(*) filter (n = 1) as singletons, max(n) as largest, sum(n - 1)::bigint as duplicates from (from a union all from b union all from c) group by kind""",
)
def agg11_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The scale audit of the orders as traces, as counts and as likelihoods."""
    call = lambda j: F.coalesce(F.max(F.when(F.col("probe") == j, F.col("call") + 1)), F.lit(0))
    traces = line_traces(spark, d).groupBy("molecule").agg(F.array(*[call(j) for j in range(7)]).alias("trace")).groupBy("trace").agg(F.count("*").alias("n"))
    counts = line_classes(spark, d)
    likelihoods = A.likelihood_classes(L.score(counts, LINE_Q), 9)
    out = None
    for kind, classes in (("trace", traces), ("counts", counts), ("likelihood", likelihoods)):
        audit = C.scale_audit(classes, len(LINE_Q)).select(F.lit(kind).alias("kind"), "classes", "singletons", "largest", "duplicates")
        out = audit if out is None else out.unionByName(audit)
    return out


#: Rates of the panel's probes from the orders: shares of returned lines, moved apart.
_RATES = "rates as (select probe, 0.5 + avg(call) / 2 as alpha, avg(call) / 4 as beta from plines where call >= 0 group by probe)"


def panel_emissions(spark: SparkSession, d: str) -> DataFrame:
    """origin, q of the panel's candidates, with rates from the orders."""
    share = F.avg("call")
    rates = panel_traces(spark, d).filter("call >= 0").groupBy("probe").agg((0.5 + share / 2).alias("alpha"), (share / 4).alias("beta"))
    profiles = G.panel(spark).select("origin", F.posexplode("profile").alias("probe", "bit"))
    cells = L.emissions(profiles, rates)
    return cells.groupBy("origin").agg(F.transform(F.sort_array(F.collect_list(F.struct("probe", "q"))), lambda x: x["q"]).alias("q"))


@register(
    "mt16_closest_origins",
    f"""with {_PANEL}, {_RATES}, e as (select origin, probe, case when b[probe + 1] = 1 then alpha else beta end as q from bits, rates),
p as (select x.origin, y.origin as other, round(product(sqrt(x.q * y.q) + sqrt((1 - x.q) * (1 - y.q))), 12) as alike from e x join e y on x.probe = y.probe and x.origin < y.origin group by all),
r as (select *, row_number() over (partition by origin order by alike desc, other) as place from p)
select origin, other, round(sqrt(greatest(0, 1 - alike)), 5) as hellinger from r where place = 1""",
)
def mt16_closest(spark: SparkSession, d: str) -> DataFrame:
    """For each candidate of the panel the later one whose outcomes are hardest to tell apart."""
    found = origin_products(panel_emissions(spark, d)).filter("other > origin")
    distance = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("alike")))
    return found.select(F.col("origin").cast("long").alias("origin"), F.col("other").cast("long").alias("other"), F.round(distance, 5).alias("hellinger"))


SHIFTS = (0.05, -0.05, 0.5)
_PROBE = 3
_SHIFTED = [P.shifted_panel(Q, _PROBE, s) for s in SHIFTS]


def _recursive(models: str, count: int, start: str) -> str:
    """CTEs up to em(it, s, k, w): EM steps of several models of the classes side by side; models has (s, n, ll)."""
    return f"""s0 as (select row_number() over () as c, * from ({models})),
l as (select s, c, n, generate_subscripts(ll, 1) - 1 as k, unnest(list_transform(ll, lambda x: exp(x - list_max(ll)))) as p from s0),
em(it, s, k, w) as (select 0, s, k, {start} from (select unnest(range({count})) as s), (select unnest(range(8)) as k)
  union all select it + 1, s, k, sum(g) / sum(sum(g)) over (partition by s) from (select it, l.s, l.k, l.n * l.p * w / sum(l.p * w) over (partition by l.s, l.c) as g from l join em on l.k = em.k and l.s = em.s where it < {ITERATIONS}) group by it, s, k)"""


_MODELS = " union all ".join(f"select {i} as s, n, {_LL(q)} as ll from classes" for i, q in enumerate(_SHIFTED))


@register(
    "mt18_probe_sensitivity",
    f"""with recursive {_ORDERS}, {_COUNTS(8, "syn")}, {_recursive(_MODELS, len(SHIFTS), f"({WEIGHTS}::double[])[k + 1]")}
select ({list(SHIFTS)}::double[])[s + 1] as shift, round(sum(abs(w - ({WEIGHTS}::double[])[k + 1])) / 2, 6) as tv from em where it = {ITERATIONS} group by s""",
)
def mt18(spark: SparkSession, d: str) -> DataFrame:
    """How far the orders' fit moves from given weights when the panel's fourth probe does."""
    found = P.probe_sensitivity(order_classes(spark, d), Q, _PROBE, WEIGHTS, SHIFTS, ITERATIONS, 0.0)
    return found.select("shift", F.round("tv", 6).alias("tv"))


GATES = [[0, 1, 2, 3], [4, 5, 6, 7]]
_VISIBLE = [float(np.prod([1 - np.prod([1 - row[j] for j in g]) for g in GATES])) for row in Q]
RECOVERY = [1.0, 0.9, 0.8, 0.7, 0.9, 0.8, 0.7, 0.6]
_ACCEPTED = "list_sum(positive[1:4]) > 0 and list_sum(positive[5:8]) > 0"
_GATED = f"select 0 as s, n, {_LL(Q)} as ll from classes where {_ACCEPTED} union all select 1 as s, n, list_transform({_LL(Q)}, lambda x, k: x - ln(({_VISIBLE}::double[])[k])) as ll from classes where {_ACCEPTED}"


def shown() -> Column:
    """Counts have a positive call in every gate."""
    one, two = (F.aggregate(F.slice("positive", g[0] + 1, len(g)), F.lit(0), lambda s, x: s + x) > 0 for g in GATES)
    return one & two


def accepted(counts: DataFrame) -> DataFrame:
    """(observed, positive) rows with a positive call in every gate."""
    return counts.filter(shown())


@register(
    "yd9_gated_fits",
    f"""with recursive {_ORDERS}, {_COUNTS(8, "syn")}, {_recursive(_GATED, 2, "1.0::double / 8")},
f as (select k, max(w) filter (s = 0) as naive, max(w) filter (s = 1) as accepted from em where it = {ITERATIONS} group by k)
select k as origin, round(naive, 6) as naive, round(accepted, 6) as accepted, round(accepted / (({RECOVERY}::double[])[k + 1] * ({_VISIBLE}::double[])[k + 1]) / sum(accepted / (({RECOVERY}::double[])[k + 1] * ({_VISIBLE}::double[])[k + 1])) over (), 6) as source from f""",
)
def yd9(spark: SparkSession, d: str) -> DataFrame:
    """Fits of the orders that two gates let through, with and without the gates in the likelihood, and the source shares."""
    q = spark.createDataFrame([(k, j, p) for k, row in enumerate(Q) for j, p in enumerate(row)], "origin int, probe int, q double")
    schedule = spark.createDataFrame([(j, j, j // 4) for j in range(8)], "cycle int, probe int, gate_group int")
    visible = [r["visibility"] for r in S.gate_visibility(q, schedule).orderBy("origin").collect()]  # a row per origin
    found = P.gated_fits(accepted(order_classes(spark, d)), Q, visible, RECOVERY, ITERATIONS, 0.0)
    return found.select(F.col("origin").cast("long").alias("origin"), *[F.round(c, 6).alias(c) for c in ("naive", "accepted", "source")])


@register(
    "agg21_empirical_yield",
    f"""with {_ORDERS}, {_COUNTS(8, "syn")}, m as (select origin, ({_ACCEPTED})::int as ok from counts join drawn using (molecule)),
o as (select origin, count(*) as n_source, sum(ok)::bigint as n_accepted from m group by 1)
select origin, n_source, n_accepted, round(n_source / sum(n_source) over (), 9) as source, round(n_accepted / sum(n_accepted) over (), 9) as analyzed, round(n_accepted / n_source, 9) as yield from o""",
)
def agg21(spark: SparkSession, d: str) -> DataFrame:
    """Shares and yields of the orders' origins before and behind the gates."""
    counts = C.probe_counts(order_traces(spark, d), 8).select("molecule", shown().alias("accepted"))
    met = counts.join(order_origins(spark, d), "molecule").select("origin", "accepted")
    found = S.empirical_yield(met)
    return found.select(F.col("origin").cast("long").alias("origin"), "n_source", "n_accepted", *[F.round(c, 9).alias(c) for c in ("source", "analyzed", "yield")])


_SHARES = """shares as (select o_custkey % 768 as origin, count(*)::double / sum(count(*)) over () as truth, sum(o_totalprice) / sum(sum(o_totalprice)) over () as est from orders group by 1)"""
_FEATURES = "features as (select origin, f as feature, b[f + 6] as bit from bits, (select unnest(range(7)) as f))"
_FPAIRS = f"""fpairs as (select x.f as one, y.f as two, coalesce(sum(est) filter (b[x.f + 6] = 1 and b[y.f + 6] = 1), 0) as est, coalesce(sum(truth) filter (b[x.f + 6] = 1 and b[y.f + 6] = 1), 0) as truth
  from (select unnest(range(7)) as f) x, (select unnest(range(7)) as f) y, (shares join bits using (origin)) where x.f < y.f group by 1, 2)"""


def customer_shares(spark: SparkSession, d: str) -> DataFrame:
    """origin, truth, est: customers dealt over the panel, by their orders and by their money."""
    orders = table(spark, d, "orders").groupBy((F.col("o_custkey") % len(PANEL_STATES)).cast("int").alias("origin"))
    found = orders.agg(F.count("*").cast("double").alias("truth"), F.sum("o_totalprice").alias("est"))
    total = found.agg(F.sum("truth").alias("t"), F.sum("est").alias("e"))
    return found.crossJoin(F.broadcast(total)).select("origin", (F.col("truth") / F.col("t")).alias("truth"), (F.col("est") / F.col("e")).alias("est"))  # one row


PANEL_STATES = range(len(G.ISOFORMS) << len(G.PTMS))


def panel_features(spark: SparkSession) -> DataFrame:
    """origin, feature, bit of the panel's modifications."""
    return G.panel(spark).select("origin", F.posexplode(F.slice("profile", 6, len(G.PTMS))).alias("feature", "bit"))


@register("mt5_feature_pairs", f"with {_PANEL}, {_SHARES}, {_FPAIRS} select one, two, round(est, 9) as est, round(truth, 9) as truth from fpairs")
def mt5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Weights of every two modifications together."""
    found = M.feature_pairs(customer_shares(spark, d), panel_features(spark), "est", "truth")
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("one", "two")], F.round("est", 9).alias("est"), F.round("truth", 9).alias("truth"))


@register(
    "mt5_feature_errors",
    f"""with {_PANEL}, {_SHARES}, {_FEATURES}, {_FPAIRS},
k as (select origin // 128 as kind, sum(est) as est, sum(truth) as truth from shares group by 1),
a as (select feature, sum(est * bit) as est, sum(truth * bit) as truth from features left join shares using (origin) group by 1)
select round((select sum(abs(est - truth)) / 2 from k), 9) as kind_tv, round((select avg(abs(est - truth)) from a), 9) as marginal_mae, round((select avg(abs(est - truth)) from fpairs), 9) as pair_mae""",
)
def mt5_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of isoform totals, modifications and pairs of modifications."""
    kinds = G.panel(spark).select("origin", F.col("isoform").alias("kind"))
    found = M.feature_errors(customer_shares(spark, d), kinds, panel_features(spark))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


_BLIND = 7
TWIN_PROFILES = [[*PROFILES[k // 2 * 2][:_BLIND], k % 2] for k in range(8)]
TWIN_Q = G.designed_q(TWIN_PROFILES)
_TWINS = V.twins(TWIN_PROFILES, _BLIND)
_DARK_Q = [[0.5 if j == _BLIND else p for j, p in enumerate(row)] for row in TWIN_Q]
_SOFT = "list_transform({0}, lambda x: exp(x - list_max({0})) / list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"


@register(
    "mt21_example",
    f"""with {_ORDERS}, {_COUNTS(8, "syn")}, f as (select molecule, {_LL(TWIN_Q)} as ll, {_LL(_DARK_Q)} as dl from counts),
t as (select *, list_position(list_transform(ll, lambda x: round(x, 9)), list_max(list_transform(ll, lambda x: round(x, 9)))) - 1 as truth from f),
p as (select molecule, truth, ({_TWINS}::int[])[truth + 1] as twin, ({_SOFT.format("ll")})[truth + 1] as a, {_SOFT.format("dl")} as dark from t),
s as (select molecule, truth, twin, a, dark[truth + 1] + dark[twin + 1] as p, dark[truth + 1] / (dark[truth + 1] + dark[twin + 1]) as share from p where twin >= 0),
v as (select molecule, truth, twin, round(a * p * (1 - 2 * abs(share - 0.5)), 12) as score from s where a >= 0.6 and p >= 0.6 and abs(share - 0.5) <= 0.05)
select molecule, truth, twin, round(score, 9) as score from v order by v.score desc, molecule limit 1""",
)
def mt21(spark: SparkSession, d: str) -> DataFrame:
    """The order that one probe alone tells from its twin, most clearly."""
    counts = C.probe_counts(order_traces(spark, d), 8)
    scored = L.score(counts, TWIN_Q).withColumn("ll", F.transform("ll", lambda x: F.round(x, 9)))
    rows = scored.select("molecule", "observed", "positive", first_argmax(F.col("ll")).alias("truth"))
    found = V.pick_example(rows, TWIN_Q, _TWINS, _BLIND, 0.6)
    return found.select("molecule", *[F.col(c).cast("long").alias(c) for c in ("truth", "twin")], F.round("score", 9).alias("score"))


GROUPS = [[0, 1], [2, 3], [4, 5], [6]]
_POST = "[post[1] + post[2], post[3] + post[4], post[5] + post[6], post[7]]"


@register(
    "mt7_group_assignment",
    f"""{assignment_sql(list(range(7)))}, g as (select case when truth < 0 then -1 else truth // 2 end as truth, {_POST} as post from s),
r as (select truth >= 0 as inside, ln(greatest(post[truth + 1], 2.2250738585072014e-308)) as lg, list_sum(list_transform(post, lambda x: x * x)) - 2 * post[truth + 1] + 1 as brier, (list_position(post, list_max(post)) - 1 = truth)::int::double as ok, list_max(post) as conf from g)
select round(-avg(lg), 6) as nll, round(avg(brier), 6) as brier, round(avg(ok), 6) as accuracy, round(avg(conf), 6) as confidence, round(avg(conf) - avg(ok), 6) as overconfidence, (select count(*) from r where not inside) as excluded from r where inside""",
)
def mt7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Proper scores of the assignments to groups of origins."""
    out = A.assignment_metrics(A.group_posteriors(assignment_pairs(spark, d, list(range(7))), GROUPS))
    return out.select(*[F.round(c, 6).alias(c) for c in ("nll", "brier", "accuracy", "confidence", "overconfidence")], "excluded")


@register(
    "agg14_tolerant_groups",
    f"""with recursive {_ORDERS}, q as (select origin, list(q order by probe) as row from (select origin, probe, sum(call)::double / count(*) as q from syn where call >= 0 group by all) group by 1),
m as (select list(row order by origin) as rows from q),
g(i, reps, first) as (select 0, []::int[], null::int
  union all select i + 1, case when hit is null then list_append(reps, i) else reps end, coalesce(hit, i)
  from (select i, reps, list_filter(reps, lambda r: list_bool_and(list_transform(range(1, 9), lambda j: abs(rows[i + 1][j] - rows[r + 1][j]) <= 0.02)))[1] as hit from g, m where i < len(rows)))
select first, count(*) as members, sum(i - 1)::bigint as total from g where first is not null group by 1""",
)
def agg14(spark: SparkSession, d: str) -> DataFrame:
    """Origins of orders whose calibrated rates differ by at most two hundredths from those of a group's first one."""
    cells = L.calibrate(order_traces(spark, d))
    q = cells.groupBy("origin").agg(F.transform(F.sort_array(F.collect_list(F.struct("probe", "q"))), lambda x: x["q"]).alias("q"))
    found = close_groups(q, 0.02)
    total = F.aggregate("members", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("first", F.size("members").cast("long").alias("members"), total.alias("total"))


MARKS_Q = [[0.8, 0.2, 0.5], [0.3, 0.7, 0.4], [0.5, 0.5, 0.9], [0.2, 0.3, 0.1]]


def line_marks(lines: DataFrame) -> DataFrame:
    """Each line as a molecule of three calls: quantity, discount and tax against a bound, taxes of accepted lines missing."""
    tax = (F.col("l_returnflag") != "A").cast("int")
    hits = F.array((F.col("l_quantity") > 25).cast("int"), (F.col("l_discount") > 0.05).cast("int"), (F.col("l_tax") > 0.04).cast("int") * tax)
    return lines.select(F.array(F.lit(1), F.lit(1), tax).alias("observed"), hits.alias("positive"))


@register(
    "stream_refit",
    f"""with recursive m as (select [1, 1, (l_returnflag <> 'A')::int] as observed, [(l_quantity > 25)::int, (l_discount > 0.05)::int, (l_tax > 0.04)::int * (l_returnflag <> 'A')::int] as positive from lineitem),
classes as (select observed, positive, count(*) as n from m group by 1, 2),
s as (select row_number() over () as c, n, {_LL(MARKS_Q)} as ll from classes),
l as (select c, n, generate_subscripts(ll, 1) - 1 as k, unnest(list_transform(ll, lambda x: exp(x - list_max(ll)))) as p from s),
em(it, k, w) as (select 0, k, 1.0::double / 4 from (select unnest(range(4)) as k)
  union all select it + 1, k, sum(g) / (select sum(n) from classes) from (select it, l.k, l.n * l.p * w / sum(l.p * w) over (partition by l.c) as g from l join em on l.k = em.k where it < {ITERATIONS}) group by it, k)
select k as origin, round(w, 6) as weight, (select count(*) from m)::double as n from em where it = {ITERATIONS}""",
)
def stream_refit(spark: SparkSession, d: str) -> DataFrame:
    """The lines read as a stream of files, counted batch by batch and fitted after each."""
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    folder = f"{shared_folder(spark)}/refit-{uuid.uuid4().hex}"
    refit_stream(line_marks(lines), MARKS_Q, folder, ITERATIONS, 0.0).awaitTermination()
    found = fits(spark, folder)
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch").select(F.col("origin").cast("long").alias("origin"), F.round("weight", 6).alias("weight"), "n")


@register(
    "mt17_score_gram",
    f"""with {_ORDERS}, {_COUNTS(8, "syn")}, s as (select n, {_LL(Q)} as ll from classes), c as (select n, list_transform(ll, lambda x: x - list_avg(ll)) as x from s),
k as (select unnest(range(8)) as a) select k.a as a, j.a as b, round(sum(n * x[k.a + 1] * x[j.a + 1]), 4) + 0.0 as value from c, k, k j group by all""",
)
def mt17_gram(spark: SparkSession, d: str) -> DataFrame:
    """Weighted products of the order classes' centred scores."""
    found = score_gram(L.score(order_classes(spark, d), Q)).select(F.col("row").cast("long").alias("a"), F.posexplode("vec").alias("b", "x"))
    return found.select("a", F.col("b").cast("long").alias("b"), (F.round("x", 4) + 0.0).alias("value"))


@register(
    "bs1_draw_totals",
    f"""with {_ORDERS}, {_COUNTS(8, "syn")} select r as replicate, (select count(*) from counts) as total from (select unnest(range(50)) as r)""",
)
def bs1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every bootstrap replicate draws as many molecules as there are orders with lines."""
    draws = B.resample(L.score(order_classes(spark, d), Q), 50)
    each = draws.select(F.posexplode("draws").alias("replicate", "x")).groupBy(F.col("replicate").cast("long").alias("replicate"))
    return each.agg(F.sum("x").alias("total"))


@register("prj8_cpm", "select o_orderpriority as priority, round_even(count(*) / sum(count(*)) over () * 1000000, 0)::bigint as cpm from orders group by 1")
def prj8(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each priority per million."""
    found = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("priority", cpm(F.col("n") / F.col("total")).alias("cpm"))  # one row


_CENTRES = [5.0, 25.0, 45.0]


@register(
    "em4_supplied_likelihoods",
    f"""with recursive c as (select l_quantity as q, count(*) as n from lineitem group by 1),
l as (select q, n, k, exp(-pow(q - ({_CENTRES}::double[])[k + 1], 2) / 200) as p from c, (select unnest(range(3)) as k)),
em(it, k, w) as (select 0, k, 1.0::double / 3 from (select unnest(range(3)) as k)
  union all select it + 1, k, sum(g) / (select sum(n) from c) from (select it, l.k, l.n * l.p * w / sum(l.p * w) over (partition by l.q) as g from l join em on l.k = em.k where it < {ITERATIONS}) group by it, k)
select k as origin, round(w, 6) as weight from em where it = {ITERATIONS}""",
)
def em4(spark: SparkSession, d: str) -> DataFrame:
    """Lines as draws around three quantities, by likelihoods that the caller gives."""
    q = F.col("l_quantity")
    classes = table(spark, d, "lineitem").groupBy(q).agg(F.count("*").alias("n"))
    found = E.fit_em(classes.select("n", F.array(*[-F.pow(q - c, F.lit(2)) / 200 for c in _CENTRES]).alias("ll")), max_iter=ITERATIONS, tol=0.0)
    return spark.createDataFrame([(k, round(float(w), 6)) for k, w in enumerate(found.weights)], "origin long, weight double")
