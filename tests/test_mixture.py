"""Closed-form cases of the mixture engine."""

import math

import numpy as np
import pytest

from mixtide.operators import classes as C
from mixtide.operators import likelihood as L
from mixtide.plans import em as E


def scored(spark, ll, n):
    return spark.createDataFrame([(float(k), [float(x) for x in row]) for row, k in zip(ll, n, strict=True)], "n double, ll array<double>")


def long_traces(spark, y, schedule):
    return spark.createDataFrame([(i, schedule[c], v) for i, row in enumerate(y) for c, v in enumerate(row)], "molecule long, probe int, call int")


def test_quick_start(spark):
    q = [[0.9, 0.1, 0.8], [0.15, 0.85, 0.8]]
    y = [[1, 0, -1, 1, 0, 0], [0, 1, 0, 0, 1, 1], [1, 0, 1, 1, 0, 1]]
    found = C.count_classes(C.probe_counts(long_traces(spark, y, [0, 1, 2, 0, 1, 2]), 3))
    assert E.fit(L.score(found, q)).weights == pytest.approx([0.6665, 0.3335], abs=1e-4)


def test_supplied_likelihoods(spark):
    ll = np.log([[0.9, 0.1], [0.1, 0.9], [0.5, 0.5]])
    assert E.fit(scored(spark, ll, [60, 30, 10])).weights == pytest.approx([0.7083, 0.2917], abs=1e-4)


def test_multimapper_and_flat_mass(spark):
    inf = -math.inf
    fit = E.fit(scored(spark, [[0, inf], [0, 0], [inf, 0]], [60, 20, 20]))
    assert fit.weights == pytest.approx([0.75, 0.25], abs=1e-6)
    fit = E.fit(scored(spark, [[0, inf], [inf, 0], [0, 0]], [60, 20, 10000]))
    assert fit.expected_counts == pytest.approx([7560, 2520]) and fit.n_iter <= 3


def test_impossible_row_without_count(spark):
    assert E.fit(scored(spark, [[0, -math.inf], [-math.inf, -math.inf]], [3, 0])).weights == pytest.approx([1, 0])
    with pytest.raises(ValueError):
        E.fit(scored(spark, [[-math.inf, -math.inf]], [1]))


def test_row_offsets_do_not_matter(spark):
    ll = np.log([[0.9, 0.1], [0.1, 0.9]])
    a = E.fit(scored(spark, ll, [3, 1])).weights
    b = E.fit(scored(spark, ll + [[1e8], [-1e8]], [3, 1])).weights
    assert a == pytest.approx(b, abs=1e-6)


def test_sufficient_counts_and_invariant_probe(spark):
    y = [[1, 0, 1, 1], [0, 1, 1, 1]]
    found = C.count_classes(C.probe_counts(long_traces(spark, y, [0, 0, 1, 1]), 2))
    row = found.first()
    assert (row["positive"], row["observed"], row["n"]) == ([1, 2], [2, 2], 2)
    kept, keep, offset = C.drop_invariant_probes(found, [[0.9, 0.5], [0.2, 0.5]])
    assert keep == [0] and kept.count() == 1
    assert found.agg(offset.alias("x")).first()["x"] == pytest.approx(-2.7726, abs=1e-4)


def test_missing_everything_keeps_the_start(spark):
    fit = E.fit(scored(spark, [[0.0, 0.0]], [5]), initial=[0.2, 0.8])
    assert fit.weights == pytest.approx([0.2, 0.8]) and fit.n_iter == 0 and fit.converged


def test_hard_counts_split_ties(spark):
    found = {r["origin"]: r["count"] for r in E.hard_counts(scored(spark, [[0, 0], [0, 0]], [1, 1])).collect()}
    assert found == {0: 1.0, 1: 1.0}


def test_matrix_scores_of_certain_calls(spark):
    """A count of 0 adds 0 where a logarithm is -Infinity; K = 768 candidates score in one product."""
    from mixtide.sources import generators as G

    rows = spark.createDataFrame([([2, 1], [2, 0], 1), ([0, 0], [0, 0], 2)], "observed array<int>, positive array<int>, n int")
    found = [r["ll"] for r in L.score(rows, [[1.0, 0.0], [0.0, 0.5]]).orderBy("n").collect()]
    assert found[0] == [0.0, -math.inf] and found[1] == [0.0, 0.0]
    q = G.panel_q(spark)
    assert len(q) == 768 and len(q[0]) == 12
    seen = np.array([3, 0, 1, 2, 2, 1, 1, 0, 3, 1, 2, 1])
    one = spark.createDataFrame([(seen.tolist(), (seen // 2).tolist())], "observed array<int>, positive array<int>")
    want = [sum(p * math.log(x) + (o - p) * math.log(1 - x) for o, p, x in zip(seen, seen // 2, row, strict=True)) for row in q]
    assert L.score(one, q).first()["ll"] == pytest.approx(want)
    with pytest.raises(ValueError):
        L.score(one, [[0.5, 1.5]])


def test_panel_ids_and_rates(spark):
    from mixtide.sources import generators as G

    rows = {r["origin"]: r for r in G.panel(spark, 2).collect()}
    assert (rows[0]["candidate_id"], rows[0]["profile"]) == ("0N3R|unmodified", [1, 1, 1, 0, 0, *[0] * 7] * 2)
    assert rows[5 * 128 + 127]["candidate_id"] == "2N4R|" + "+".join(G.PTMS) and rows[640 + 127]["profile"] == [1, 1, 0, 1, 1, *[1] * 7] * 2
    assert rows[1]["candidate_id"] == "0N3R|pS396" and G.probe_rates(spark, 3).count() == 36


def test_inputs_are_checked(spark):
    q = [[0.9, 0.1], [0.1, 0.9]]
    for bad in ([[7, 0]], [[2, 1]]):
        with pytest.raises(Exception, match="calls must be"):
            E.fit_em(long_traces(spark, bad, [0, 1]), q)
    with pytest.raises(Exception, match="probe is outside"):
        E.fit_em(long_traces(spark, [[1, 0]], [0, 9]), q)
    schedule = spark.createDataFrame([(0, 0)], "cycle int, probe int")
    cells = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "molecule int, cycle int, call int")
    with pytest.raises(Exception, match="probe is outside"):
        E.fit_em(cells, q, schedule)
    for n in (-1, 1.5, float("nan")):
        with pytest.raises(ValueError, match="counts"):
            E.fit(scored(spark, [[0, -1], [-1, 0]], [3, n]))
    with pytest.raises(ValueError, match="initial"):
        E.fit(scored(spark, [[0, -1]], [3]), initial=[2, -1])


def test_fit_em_takes_three_inputs(spark):
    q = [[0.9, 0.1, 0.5], [0.15, 0.85, 0.5]]
    y = [[1, 0, 1], [0, 1, 0], [1, 0, 0], [1, 1, 1], [-1, -1, 1]]
    traces = long_traces(spark, y, [0, 1, 2])
    found = C.count_classes(C.probe_counts(traces, 3))
    fits = [E.fit_em(traces, q), E.fit_em(found, q), E.fit_em(L.score(found, q), q)]
    cells = traces.withColumnRenamed("probe", "cycle")
    fits.append(E.fit_em(cells, q, spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "cycle int, probe int")))
    for f in fits[1:]:
        assert f.weights == pytest.approx(fits[0].weights, abs=1e-7) and f.history[-1] == pytest.approx(fits[0].history[-1], rel=1e-9)


def test_observation_scores_follow_their_classes(spark):
    q = [[0.9, 0.1], [0.2, 0.7]]
    counts = C.probe_counts(long_traces(spark, [[1, 0], [1, 0], [0, -1]], [0, 1]), 2)
    found = {r["molecule"]: r["ll"] for r in L.score_observations(counts, q, "observed", "positive").collect()}
    assert found[0] == found[1] == pytest.approx([2 * math.log(0.9), math.log(0.2) + math.log(0.3)]) and found[2] == pytest.approx([math.log(0.1), math.log(0.8)])


def test_rank_sums_run_without_a_window_over_all_rows(spark):
    from mixtide.functions.ranks import running_totals
    from mixtide.operators import metrics as M
    from pyspark.sql import functions as F

    rows = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(20)).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    found = running_totals(rows, [F.col("score"), F.col("id")], "label").orderBy("score", "id").collect()
    want = 0
    for r in found:
        assert r["before_label"] == want
        want += r["label"]
    order = sorted(((-r["score"], r["id"], r["label"]) for r in found))
    hits, total = 0, 0.0
    for k, (_, _, label) in enumerate(order):
        hits += label
        total += label * hits / (k + 1)
    assert M.average_precision(rows).first()["ap"] == pytest.approx(total / hits)
    plan = M.average_precision(rows)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # ranged once, in a checkpoint; summed where the rows are


def test_selection_errors(spark):
    from mixtide.operators import selection as S

    zero = spark.createDataFrame([(0, 0.5, 0.0), (1, 0.5, 0.0)], "origin int, w double, e double")
    for f in (S.source_to_analyzed, S.analyzed_to_source):
        with pytest.raises(Exception, match="yields"):
            f(zero).collect()


def test_files_round_trip(spark, tmp_path):
    from mixtide.sources import generators as G
    from mixtide.sources import tsv as T

    (tmp_path / "q.tsv").write_text("id\tp1\tp2\nA\t0.9\t0.1\nB\t0.2\t0.8\n")
    (tmp_path / "schedule.tsv").write_text("cycle\tprobe\n0\tp2\n1\tp1\n")
    (tmp_path / "truth.tsv").write_text("candidate_id\tcpm\nB\t250000\n")
    (tmp_path / "traces.tsv").write_text("molecule\tc01\tc02\nm1\t1\t0\nm2\t-1\t1\n")
    q_path = tmp_path / "q2.tsv"
    q_path.write_text((tmp_path / "q.tsv").read_text().replace("id\t", "candidate_id\t"))
    assert [(r[0], r[1]) for r in T.read_q(spark, str(q_path), ["p1", "p2"]).collect()] == [("A", [0.9, 0.1]), ("B", [0.2, 0.8])]
    schedule = T.read_schedule(spark, str(tmp_path / "schedule.tsv"), ["p1", "p2"])
    assert sorted(map(tuple, schedule.collect())) == [(0, 1), (1, 0)]
    with pytest.raises(Exception, match="unknown probe"):
        T.read_schedule(spark, str(tmp_path / "schedule.tsv"), ["p1"]).collect()
    names = spark.createDataFrame([(0, "A"), (1, "B")], "origin int, candidate_id string")
    assert {r["candidate_id"]: r["truth"] for r in T.read_truth(spark, str(tmp_path / "truth.tsv"), names).collect()} == {"A": 0.0, "B": 0.25}
    long = T.to_long(T.read_traces(spark, str(tmp_path / "traces.tsv"), 2), schedule)
    assert sorted((r["molecule"], r["probe"], r["call"]) for r in long.collect()) == [("m1", 0, 0), ("m1", 1, 1), ("m2", 0, 1), ("m2", 1, -1)]
    T.write_abundances(names.selectExpr("origin", "candidate_id", "double(0.5) as w"), str(tmp_path / "out"), "s1", "f", "l", "g")
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["flowcell", "lane", "sample", "sample_group", "candidate_id", "estimated_cpm"] and [r["candidate_id"] for r in back.collect()] == ["A", "B"]
    T.write_panel(G.panel(spark), [r["probe_id"] for r in G.probe_rates(spark).collect()], str(tmp_path / "panel"))
    assert len(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "panel")).columns) == 14
    rows = spark.createDataFrame([(0, "A", 0.25, 1 / 3, 0.0, 1.0)], "origin int, candidate_id string, truth double, hard double, binary double, weighted double")
    T.write_comparison(rows, str(tmp_path / "comparison"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "comparison")).first()["hard_cpm"] == "333333"


def test_contrast_shrinks_about_the_mean(spark):
    rates = spark.createDataFrame([(0, 0.9, 0.1), (1, 0.8, 0.2)], "probe int, alpha double, beta double")
    found = {r["probe"]: (r["alpha"], r["beta"]) for r in L.shrink_contrast(rates, 0, 0.5).collect()}
    assert found[0] == pytest.approx((0.7, 0.3)) and found[1] == (0.8, 0.2)
