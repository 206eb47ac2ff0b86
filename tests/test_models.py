"""Checks of counts and likelihoods, membership, repeats, bootstrap draws, diagnostics and joint fits on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

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
from mixtide.plans.conditioning import close_groups, conditioning, emission_diagnostics
from mixtide.sources import generators, tsv

Q = [[0.9, 0.2, 0.6], [0.3, 0.7, 0.5], [0.1, 0.4, 0.8]]
COUNTS = "molecule long, observed array<int>, positive array<int>, n long"
ROWS = [(1, [3, 2, 1], [2, 0, 1], 4), (2, [0, 0, 0], [0, 0, 0], 5), (3, [1, 1, 2], [1, 1, 0], 1), (4, [3, 3, 3], [0, 3, 1], 2)]


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame(ROWS, COUNTS)


def numpy_scores(rows, q=Q):
    seen, hit = (np.array([r[k] for r in rows], float) for k in (1, 2))
    return hit @ np.log(q).T + (seen - hit) @ np.log1p(-np.array(q)).T


@pytest.mark.parametrize(
    "bad, said",
    [
        ((9, None, None, 1), "null"),
        ((9, [1, 1], [1, 1], 1), "3 entries"),
        ((9, [1, None, 1], [0, 0, 0], 1), "null entry"),
        ((9, [1, 1, 1], [2, 0, 0], 1), "0 <= positive <= observed"),
        ((9, [-1, 1, 1], [-1, 0, 0], 1), "0 <= positive <= observed"),
    ],
)
def test_wrong_counts_are_errors(spark, bad, said):
    rows = spark.createDataFrame([*ROWS, bad], COUNTS).repartition(1)
    for scorer in (lambda d: L.score(d, Q), lambda d: R.score_repeat_aware(d, Q, 0.5)):
        with pytest.raises(Exception, match=said):
            scorer(rows).collect()
    with pytest.raises(Exception, match="counts must be 3 whole"):
        E.fit_em(rows, Q)


def test_scores_keep_to_their_rows(spark, classes):
    got = {r["molecule"]: r["ll"] for r in L.score(classes, Q).collect()}
    assert np.allclose([got[r[0]] for r in ROWS], numpy_scores(ROWS))


@pytest.mark.parametrize("n", [-1.0, None, 1.5, math.nan])
def test_wrong_class_counts_are_errors(spark, n):
    rows = spark.createDataFrame([(float(r[3]), [0.0, -1.0]) for r in ROWS] + [(n, [0.0, -1.0])], "n double, ll array<double>")
    with pytest.raises(ValueError, match="counts"):
        E.fit(rows)
    with pytest.raises(Exception, match="counts must be finite"):
        C.count_classes(rows.withColumns({"observed": F.array(F.lit(1)), "positive": F.array(F.lit(1))}), F.col("n")).collect()


@pytest.mark.parametrize("ll", [[0.0, None], [0.0, math.nan], [0.0, math.inf], None, [], [0.0], [-math.inf, -math.inf]])
def test_wrong_likelihoods_are_errors(spark, ll):
    good = [(2, [0.0, -1.0]), (1, [-3.0, 0.0])]
    with pytest.raises(ValueError, match="log-likelihoods"):
        E.fit(spark.createDataFrame([*good, (1, ll)], "n long, ll array<double>"))
    plain = E.fit(spark.createDataFrame(good, "n long, ll array<double>"))
    zero = E.fit(spark.createDataFrame([*good, (0, ll)], "n long, ll array<double>"))
    assert np.array_equal(plain.weights, zero.weights)


def test_fit_em_takes_profiles(spark, classes):
    profiles, alpha, beta = [[1, 0, 1], [0, 1, 1]], [0.9, 0.8, 0.7], 0.1
    q = L.emission_matrix(profiles, alpha, beta)
    assert q == [[0.9, 0.1, 0.7], [0.1, 0.8, 0.7]]
    one, two = E.fit_em(classes, q), E.fit_em(classes, profiles=profiles, alpha=alpha, beta=beta)
    assert np.array_equal(one.weights, two.weights)
    whole = E.fit(L.score(classes, q))
    assert one.history[-1] == pytest.approx(whole.history[-1])  # the third probe is an offset
    assert E.objective(L.score(classes, q), one.weights) == pytest.approx(one.history[-1])
    for wrong in ({}, {"q": q, "profiles": profiles, "alpha": 0.9, "beta": 0.1}, {"profiles": profiles}):
        with pytest.raises(ValueError):
            E.fit_em(classes, **wrong)
    for bits in ([[1, 2]], [[1], [0, 1]], []):
        with pytest.raises(ValueError):
            L.emission_matrix(bits, 0.9, 0.1)


def test_emissions_check_bits_and_rates(spark):
    rates = spark.createDataFrame([(0, 0.9, 0.1), (1, 1.5, 0.1)], "probe int, alpha double, beta double")
    rows = lambda *r: L.emissions(spark.createDataFrame(list(r), "origin int, probe int, bit int"), rates)
    assert [tuple(r) for r in rows((0, 0, 1), (1, 0, 0)).orderBy("origin").collect()] == [(0, 0, 0.9), (1, 0, 0.1)]
    for bad in ((0, 0, 2), (0, 1, 1), (0, 5, 1), (0, 0, None)):
        with pytest.raises(Exception, match="bits must|needs rates"):
            rows(bad).collect()


def test_repeats_without_an_effect_are_independent(classes):
    got = {r["molecule"]: r["ll"] for r in R.score_repeat_aware(classes, Q, 0.0).collect()}
    assert np.allclose([got[r[0]] for r in ROWS], numpy_scores(ROWS))


def test_repeats_share_their_effect(spark):
    sigma, grid = 1.1, np.linspace(-12, 12, 40001)
    density = np.exp(-grid * grid / 2) / np.sqrt(2 * np.pi) * (grid[1] - grid[0])
    b = R.marginal_intercepts(np.array(Q), sigma)
    p = 1 / (1 + np.exp(-(b[..., None] + sigma * grid)))
    assert np.allclose(p @ density, Q, atol=1e-6)
    one = spark.createDataFrame([(1, [4, 0, 2], [3, 0, 2], 1)], COUNTS)
    want = np.log((p[:, 0] ** 3 * (1 - p[:, 0])) @ density) + np.log(p[:, 2] ** 2 @ density)
    assert np.allclose(R.score_repeat_aware(one, Q, sigma).first()["ll"], want, atol=1e-6)
    single = spark.createDataFrame([(1, [1, 1, 1], [1, 0, 1], 1)], COUNTS)
    assert np.allclose(R.score_repeat_aware(single, Q, sigma).first()["ll"], numpy_scores([(1, [1, 1, 1], [1, 0, 1])])[0])
    certain = R.score_repeat_aware(single, [[1.0, 0.0, 0.5], [0.0, 0.5, 0.5]], sigma).first()["ll"]
    assert certain[0] == pytest.approx(math.log(0.5)) and certain[1] == -math.inf


def test_membership_has_every_molecule_once(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [0, 0, 0], [0, 0, 0]) if k % 3 == 0 else (k, [1, 2, 1], [int(rng.integers(2)), int(rng.integers(3)), int(rng.integers(2))]) for k in range(900)]
    rows += [(k, [1, 1, k % 50], [0, 1, k % 7]) for k in range(900, 1000) if k % 50 >= 6]
    counts = spark.createDataFrame(rows, "molecule long, observed array<int>, positive array<int>")
    got = {r["molecule"]: r for r in N.membership(counts, Q).collect()}
    assert len(got) == len(rows)
    keys = sorted({(tuple(o), tuple(p)) for _, o, p in rows})
    scores = numpy_scores(rows)
    centred = np.round(scores - scores.max(axis=1, keepdims=True), 9) + 0.0
    order = sorted(set(map(tuple, centred.tolist())))
    for (m, o, p), ll, c in zip(rows, scores, centred.tolist(), strict=True):
        assert got[m]["count_class"] == keys.index((tuple(o), tuple(p))) and got[m]["likelihood_class"] == order.index(tuple(c))
        assert got[m]["log_offset"] == pytest.approx(ll.max())
    plan = N.membership(counts, Q)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan  # the class without calls does not go to one task


def test_binary_classes(spark, classes):
    profiles = [[int(b) for b in f"{k % 8:03b}"] for k in range(70)]
    found = N.binary_classes(classes, profiles).select(N.origins_in(F.col("compatible"), 70).alias("o"), N.binary_scores(F.col("compatible"), 70).alias("ll"), "n", "members").collect()
    want = {}
    for _, seen, hit, n in ROWS:
        wrong = [sum(seen[j] - hit[j] if b else hit[j] for j, b in enumerate(row)) for row in profiles]
        key = tuple(k for k, x in enumerate(wrong) if x == min(wrong))
        want[key] = (want.get(key, (0, 0))[0] + n, want.get(key, (0, 0))[1] + 1)
    assert {tuple(r["o"]): (r["n"], r["members"]) for r in found} == want
    assert all([k for k, x in enumerate(r["ll"]) if x == 0.0] == r["o"] for r in found)


def test_draws_are_multinomial(spark, monkeypatch):
    monkeypatch.setattr(B, "TOGETHER", 7)
    monkeypatch.setattr(B, "BUCKETS", 5)
    n = [1 + k % 9 for k in range(60)]
    rows = spark.createDataFrame([(c, [0.0, -float(k)]) for k, c in enumerate(n)] + [(0, [0.0, 1.0])], "n long, ll array<double>")
    draws = {tuple(r["ll"]): r["draws"] for r in B.resample(rows, 400).collect()}
    again = {tuple(r["ll"]): r["draws"] for r in B.resample(rows.repartition(9), 400).collect()}
    assert draws == again and len(draws) == 60
    x = np.array([draws[0.0, -float(k)] for k in range(60)], float)
    assert (x.sum(axis=0) == sum(n)).all()
    p = np.array(n) / sum(n)
    assert np.abs(x.mean(axis=1) - sum(n) * p).max() < 5 * np.sqrt(sum(n) * p.max() / 400)
    expected = sum(n) * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(x) - expected).max() < 0.35 * expected.max()


def test_bootstrap_refits_its_draws(spark):
    ll = [[0.0, -1.5, -3.0], [-2.0, 0.0, -0.5], [-0.3, -0.2, 0.0], [0.0, 0.0, -1.0]]
    rows = spark.createDataFrame(list(zip([40, 25, 30, 5], ll, strict=True)), "n long, ll array<double>")
    base = E.fit(rows)
    found = B.bootstrap(rows, base.weights, 6)
    got = {(r["replicate"], r["origin"]): r["w"] for r in found.collect()}
    hard = {(r["replicate"], r["origin"]): r["w"] for r in B.bootstrap(rows, base.weights, 6, estimator="hard").collect()}
    draws = {tuple(r["ll"]): r["draws"] for r in B.resample(rows, 6).collect()}
    for b in range(6):
        sampled = [(draws[tuple(x)][b], x) for x in ll]
        fit = E.fit(spark.createDataFrame(sampled, "n long, ll array<double>"), initial=(base.weights + 1e-9).tolist())
        assert np.allclose([got[b, o] for o in range(3)], fit.weights, atol=1e-6)
        counts = np.zeros(3)
        for n, x in sampled:
            counts[int(np.argmax(x))] += n
        assert np.allclose([hard[b, o] for o in range(3)], counts / 100)
    groups = {(r["replicate"], r["origin"]): r["w"] for r in B.grouped(found, [[0, 2], [1]]).collect()}
    assert all(groups[b, 0] == pytest.approx(got[b, 0] + got[b, 2]) for b in range(6))
    for wrong in ([[0, 1]], [[0, 1], [1, 2]], [[0, 1, 2], []]):
        with pytest.raises(ValueError, match="groups"):
            B.grouped(found, wrong)
    late = B.bootstrap(rows, base.weights, 2, max_iter=1, tol=0.0).collect()
    assert {(r["w"], r["converged"]) for r in late} == {(None, False)}
    with pytest.raises(ValueError, match="estimator"):
        B.bootstrap(rows, base.weights, 2, estimator="soft")


def test_emission_diagnostics(spark):
    q = np.array([[0.9, 0.2, 0.6], [0.3, 0.7, 0.5], [0.9, 0.2, 0.6], [0.85, 0.2, 0.6]])
    outcomes = np.array([[int(b) for b in f"{k:03b}"] for k in range(8)])
    p = np.prod(np.where(outcomes[None], q[:, None], 1 - q[:, None]), axis=2)
    frame = lambda x: spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "origin int, q array<double>")
    found = emission_diagnostics(frame(q))
    assert found["rank"] == 3 and found["condition"] == math.inf and found["closest_pair"] == (0, 2) and found["minimum_hellinger"] == 0.0
    assert found["largest"] == pytest.approx(np.linalg.svd(p)[1][0])
    full, values = emission_diagnostics(frame(q[[0, 1, 3]])), np.linalg.svd(p[[0, 1, 3]])[1]
    assert full["rank"] == 3 and full["condition"] == pytest.approx(values[0] / values[2], rel=1e-6) and full["closest_pair"] == (0, 2)
    distance = np.sqrt(1 - np.sqrt(p[0] * p[3]).sum())
    assert full["minimum_hellinger"] == pytest.approx(distance)
    assert emission_diagnostics(frame(q[:1]))["closest_pair"] == (0, 0)
    with pytest.raises(ValueError):
        emission_diagnostics(frame(q + 0.5))


def test_conditioning_over_partitions(spark):
    rng = np.random.default_rng(2)
    ll, n = rng.normal(size=(40, 4)), rng.integers(1, 9, 40)
    rows = spark.createDataFrame([(int(c), x.tolist()) for c, x in zip(n, ll, strict=True)], "n long, ll array<double>").repartition(5)
    x = np.sqrt(n)[:, None] * (ll - ll.mean(axis=1, keepdims=True))
    assert np.allclose(conditioning(rows)["singular_values"][:3], np.linalg.svd(x)[1][:3])


def test_sensitivity_equals_separate_fits(spark, classes):
    base = E.fit_em(classes, Q)
    found = {r["shift"]: r for r in P.probe_sensitivity(classes, Q, 1, base.weights.tolist(), (0.3, -0.3)).collect()}
    for shift, r in found.items():
        moved = P.shifted_panel(Q, 1, shift)
        assert moved[0][1] == pytest.approx(1 / (1 + math.exp(-(math.log(0.2 / 0.8) + shift))))
        alone = E.fit(L.score(classes, moved), initial=base.weights.tolist())
        assert r["converged"] and r["tv"] == pytest.approx(np.abs(alone.weights - base.weights).sum() / 2, abs=1e-6)
    assert P.shifted_panel([[0.0, 1.0]], 1, 2.0) == [[0.0, 1.0]]


def test_gated_fits_show_the_naive_bias(spark):
    q, share = [[0.9, 0.6], [0.2, 0.1]], [0.3, 0.7]
    visible = [1 - (1 - a) * (1 - b) for a, b in q]
    rows = []
    for one in (0, 1):
        for two in (0, 1):
            if one or two:
                p = sum(w * (r[0] if one else 1 - r[0]) * (r[1] if two else 1 - r[1]) for w, r in zip(share, q, strict=True))
                rows.append((0, [1, 1], [one, two], round(1e9 * p)))
    found = P.gated_fits(spark.createDataFrame(rows, COUNTS), q, visible, [1.0, 1.0], 5000, 1e-13).orderBy("origin").collect()
    kept = [w * v for w, v in zip(share, visible, strict=True)]
    assert found[0]["accepted"] == pytest.approx(kept[0] / sum(kept), abs=1e-4)
    assert found[0]["source"] == pytest.approx(0.3, abs=1e-4)
    assert abs(found[0]["naive"] - kept[0] / sum(kept)) > 0.04
    with pytest.raises(ValueError, match="positive"):
        P.gated_fits(spark.createDataFrame(rows, COUNTS), q, [0.0, 1.0], [1.0, 1.0])


def test_yields(spark):
    rows = [(0, True), (0, False), (0, None), (1, True)]
    found = {r["origin"]: tuple(r)[1:] for r in S.empirical_yield(spark.createDataFrame(rows, "origin int, accepted boolean")).collect()}
    assert found[0] == (3, 1, 0.75, 0.5, pytest.approx(1 / 3)) and found[1] == (1, 1, 0.25, 0.5, 1.0)
    q = spark.createDataFrame([(0, 0, 0.5)], "origin int, probe int, q double")
    with pytest.raises(ValueError, match="no known probe"):
        S.gate_visibility(q, spark.createDataFrame([(0, 3, 0)], "cycle int, probe int, gate_group int"))


def test_feature_errors(spark):
    weights = spark.createDataFrame([(0, 0.5, 0.25), (1, 0.5, 0.25), (2, 0.0, 0.5)], "origin int, est double, truth double")
    kinds = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "origin int, kind string")
    bits = [[1, 1, 0], [0, 1, 1], [1, 0, 0]]
    features = spark.createDataFrame([(o, f, b) for o, row in enumerate(bits) for f, b in enumerate(row)], "origin int, feature int, bit int")
    pairs = {(r["one"], r["two"]): (r["est"], r["truth"]) for r in M.feature_pairs(weights, features, "est", "truth").collect()}
    assert pairs == {(0, 1): (0.5, 0.25), (1, 2): (0.5, 0.25), (0, 2): (0.0, 0.0)}
    found = M.feature_errors(weights, kinds, features).first()
    assert found["kind_tv"] == pytest.approx(0.25) and found["pair_mae"] == pytest.approx(0.5 / 3)
    assert found["marginal_mae"] == pytest.approx((0.25 + 0.5 + 0.25) / 3)


def test_group_posteriors(spark):
    rows = spark.createDataFrame([([0.5, 0.3, 0.2], 2, 1), ([0.1, 0.2, 0.7], -1, 1)], "post array<double>, truth int, n long")
    found = A.group_posteriors(rows, [[0, 2], [1]]).collect()
    assert found[0]["post"] == pytest.approx([0.7, 0.3]) and [r["truth"] for r in found] == [0, -1]


def test_twins_and_example(spark):
    profiles = [[1, 0, 1], [1, 0, 0], [0, 1, 1], [0, 1, 0], [1, 1, 1]]
    assert V.twins(profiles, 2) == [1, 0, 3, 2, -1]
    q = L.emission_matrix(profiles, 0.95, 0.05)
    rows = spark.createDataFrame([(7, [2, 2, 2], [2, 0, 2], 0), (5, [2, 2, 2], [2, 0, 2], 0), (1, [2, 2, 2], [2, 2, 2], 4), (2, [2, 2, 0], [2, 0, 0], 0), (3, [2, 2, 2], [0, 2, 0], 3)], "molecule long, observed array<int>, positive array<int>, truth int")
    found = V.pick_example(rows, q, V.twins(profiles, 2), 2).collect()
    assert [tuple(r)[:3] for r in found] == [(3, 3, 2)] and found[0]["score"] > 0.9
    alone = V.pick_example(rows.filter("molecule <> 3"), q, V.twins(profiles, 2), 2).first()
    assert alone["molecule"] == 5  # the smaller of two equals
    assert V.pick_example(rows.filter("molecule = 1"), q, V.twins(profiles, 2), 2).count() == 0


def test_cohort_reruns_replace_their_sample_alone(spark, tmp_path):
    def sample(name, *w):
        rows = [("fc1", "1", name, "g", f"c{o}", o, x) for o, x in enumerate(w)]
        return spark.createDataFrame(rows, "flowcell string, lane string, sample string, sample_group string, candidate_id string, origin int, w double")

    path = f"{tmp_path}/cohort"
    files = lambda name: sorted((p.name, p.read_text()) for p in (tmp_path / "cohort" / f"sample={name}").glob("*.csv"))
    tsv.write_cohort(sample("s1", 0.25, 0.75).unionByName(sample("s2", 0.5, 0.5)), path)
    first, other = files("s1"), files("s2")
    assert first[0][1].splitlines()[1:] == ["fc1\t1\tg\tc1\t750000", "fc1\t1\tg\tc0\t250000"]
    tsv.write_cohort(sample("s1", 0.25, 0.75), path)
    assert [t for _, t in files("s1")] == [t for _, t in first] and files("s2") == other
    tsv.write_cohort(sample("s1", 1.0, 0.0), path)
    assert files("s2") == other
    assert {tuple(r) for r in tsv.read_cohort(spark, path).select("sample", "candidate_id", "estimated_cpm").collect()} == {("s1", "c0", 1000000), ("s1", "c1", 0), ("s2", "c0", 500000), ("s2", "c1", 500000)}


def test_trace_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m2", 0, 1), ("m2", 2, 0), ("m1", 1, -1)], "molecule string, cycle int, call int")
    tsv.write_traces(rows, f"{tmp_path}/traces", 3)
    assert [tuple(r) for r in tsv.read_traces(spark, f"{tmp_path}/traces", 3).orderBy("molecule").collect()] == [("m1", [-1, -1, -1]), ("m2", [1, -1, 0])]


def test_cumulative_posteriors(spark):
    rows = [(1, 0, 0, 1), (1, 1, 1, 0), (1, 1, 2, 1), (1, 3, 0, -1), (2, 0, 9, 1), (2, 5, 2, None), (3, 2, 1, 1)]
    cells = spark.createDataFrame(rows, "molecule long, cycle long, probe int, call int").repartition(3)
    got = {(r["molecule"], r["cycle"]): r["posterior"] for r in L.cumulative_posteriors(cells, Q).collect()}
    q, soft = np.array(Q), lambda x: x / x.sum()
    first, then = q[:, 0], q[:, 0] * (1 - q[:, 1]) * q[:, 2]
    want = {(1, 0): soft(first), (1, 1): soft(then), (1, 3): soft(then), (2, 0): np.full(3, 1 / 3), (2, 5): np.full(3, 1 / 3), (3, 2): soft(q[:, 1])}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert L.cumulative_posteriors(cells.limit(0), Q).count() == 0


def test_observations_of_a_large_class(spark):
    rows = [(k, [0, 0, 0] if k % 2 else [1, 1, k % 9], [0, 0, 0]) for k in range(600)]
    found = {r["molecule"]: r["ll"] for r in L.score_observations(spark.createDataFrame(rows, "molecule long, observed array<int>, positive array<int>"), Q, "observed", "positive").collect()}
    assert len(found) == 600 and np.allclose([found[k] for k in range(600)], numpy_scores(rows))


def test_unassigned_and_group_errors(spark):
    rows = spark.createDataFrame([([0.5, 0.5],), ([0.1, 0.9],), ([0.45, 0.55],)], "post array<double>")
    assert [r["origin"] for r in A.flag_unassigned(rows, 0.5).collect()] == [0, 1, 1]
    assert [r["origin"] for r in A.flag_unassigned(rows, 0.6).collect()] == [-1, 1, -1]
    pairs = spark.createDataFrame([(0, 0.5, 0.25), (1, 0.25, 0.5), (2, 0.25, 0.15)], "origin int, est double, truth double")
    label = lambda *g: spark.createDataFrame(list(enumerate(g)), "origin int, group_id int")
    joint = M.group_errors(pairs, label(0, 0, 1), 0.1).first()
    assert (joint["groups"], joint["resolved"], joint["origin_tv"]) == (2, False, None) and joint["tv"] == pytest.approx(0.1)
    alone = M.group_errors(pairs, label(0, 1, 2), 0.1).first()
    assert alone["resolved"] and alone["tv"] == pytest.approx(0.35) == pytest.approx(alone["origin_tv"])


def test_estimands(spark):
    found = spark.createDataFrame([(b, o, w, True) for b, ws in enumerate(((0.5, 0.3, 0.2), (0.1, 0.1, 0.8))) for o, w in enumerate(ws)], "replicate int, origin int, w double, converged boolean")
    kinds = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "origin int, kind string")
    features = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 0, 1)], "origin int, feature int, bit int")
    got = {(r["replicate"], r["estimand"]): r["w"] for r in B.estimands(found, kinds, features, [2]).collect()}
    assert got == {k: pytest.approx(v) for k, v in {(0, "kind:a"): 0.8, (0, "kind:b"): 0.2, (0, "feature:0"): 0.7, (0, "origin:2"): 0.2, (1, "kind:a"): 0.2, (1, "kind:b"): 0.8, (1, "feature:0"): 0.9, (1, "origin:2"): 0.8}.items()}
    assert B.intervals(B.estimands(found, kinds, features, [2]), by="estimand").count() == 4


def test_close_groups_are_greedy(spark):
    rng = np.random.default_rng(5)
    q = rng.integers(0, 4, (150, 2)) / 10 + 0.1
    frame = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(q)], "origin int, q array<double>")
    for atol, rtol in ((0.0, 0.0), (0.11, 0.0), (0.0, 0.6)):
        got = [r["members"] for r in close_groups(frame, atol, rtol).orderBy("first").collect()]
        assert got == L.tolerant_groups(q.tolist(), atol, rtol)
    with pytest.raises(ValueError, match="tolerances"):
        close_groups(frame, -1.0)


def test_all_traces_have_all_the_probability(spark):
    patterns = generators.bit_patterns(spark, 3).select(F.array(*[F.lit(1)] * 3).alias("observed"), F.col("bits").alias("positive"))
    found = L.score(patterns, Q).select(F.posexplode("ll").alias("origin", "x")).groupBy("origin").agg(F.sum(F.exp("x")).alias("p")).collect()
    assert len(found) == 3 and all(r["p"] == pytest.approx(1.0) for r in found)
