"""Assignments, bootstrap and groups against small cases worked out by hand or in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtide.operators import assignment as A
from mixtide.operators import likelihood as L
from mixtide.plans import bootstrap as B
from mixtide.plans.conditioning import conditioning

SCHEMA = "post array<double>, truth int, n long"


def test_assignment_metrics(spark):
    out = A.assignment_metrics(spark.createDataFrame([([0.75, 0.25], 0, 3), ([0.75, 0.25], 1, 1), ([0.5, 0.5], -1, 2)], SCHEMA)).first()
    assert out["nll"] == pytest.approx(-(3 * math.log(0.75) + math.log(0.25)) / 4)
    assert out["brier"] == pytest.approx((3 * 0.125 + 1.125) / 4)
    assert (out["accuracy"], out["confidence"], out["ece"], out["excluded"]) == (0.75, 0.75, 0.0, 2)
    assert out["coverage"] == pytest.approx(4 / 6)


def test_no_pairs(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = A.assignment_metrics(none).first()
    assert out["nll"] is None and out["excluded"] == 0
    assert A.top_k_recall(none, 2).first()["recall"] is None


def test_top_k_prefers_the_first_of_equals(spark):
    pairs = spark.createDataFrame([([0.4, 0.4, 0.2], 1, 1), ([0.4, 0.4, 0.2], 0, 1)], SCHEMA)
    assert A.top_k_recall(pairs, 1).first()["recall"] == 0.5
    assert A.top_k_recall(pairs, 2).first()["recall"] == 1.0


def test_decoder_truth(spark):
    rows = spark.range(4).select(A.decoder_truth(F.col("id"), [0, 2]).alias("t")).collect()
    assert [r["t"] for r in rows] == [0, -1, 1, -1]


def test_tolerant_groups_are_greedy():
    assert L.tolerant_groups([[0.0], [0.6], [1.2]], atol=0.7) == [[0, 1], [2]]


def test_likelihood_classes_merge_constant_shifts(spark):
    rows = spark.createDataFrame([([0.0, -1.0], 2), ([-3.0, -4.0], 5), ([0.0, -2.0], 1)], "ll array<double>, n long")
    out = {tuple(r["ll"]): (r["n"], r["log_offset"]) for r in A.likelihood_classes(rows).collect()}
    assert out == {(0.0, -1.0): (7, -15.0), (0.0, -2.0): (1, 0.0)}


def test_conditioning_counts_equal_origins_once(spark):
    ll = [[-1.0, -1.0, -2.0], [-2.0, -2.0, -0.5]]
    found = conditioning(spark.createDataFrame([(row, 3) for row in ll], "ll array<double>, n long"))
    x = np.sqrt(3) * (np.array(ll) - np.mean(ll, axis=1, keepdims=True))
    assert found["rank"] == 1
    assert found["singular_values"][0] == pytest.approx(np.linalg.svd(x)[1][0])


def test_bootstrap_brackets_the_estimate_and_ignores_partitions(spark):
    rows = [([1], [1], 600, [0.0, -30.0]), ([1], [0], 400, [-30.0, 0.0])]
    schema = "observed array<int>, positive array<int>, n long, ll array<double>"
    one, two = (B.bootstrap(spark.createDataFrame(rows, schema).repartition(p), np.array([0.6, 0.4]), 200) for p in (1, 3))
    spread = {r["origin"]: r for r in B.intervals(one).collect()}
    assert spread[0]["low"] < 0.6 < spread[0]["high"]
    assert spread[0]["high"] - spread[0]["low"] == pytest.approx(2 * 1.96 * math.sqrt(0.24 / 1000), rel=0.2)
    key = lambda d: sorted((r["replicate"], r["origin"], round(r["w"], 9)) for r in d.collect())
    assert key(one) == key(two)
    assert B.intervals(one).first()["replicates"] == 200


def test_bootstrap_without_rows(spark):
    none = spark.createDataFrame([], "observed array<int>, positive array<int>, n long, ll array<double>")
    assert {(r["w"], r["converged"]) for r in B.bootstrap(none, np.array([0.5, 0.5]), 3).collect()} == {(None, False)}


def test_outlier_report_precision(spark):
    schema = "molecule long, post array<double>, ll array<double>, observed array<int>, truth int"
    rows = [(1, [0.6, 0.4], [-4.0, -9.0], [1, 1], -1), (2, [0.6, 0.4], [-2.0, -3.0], [2, 0], 0), (3, [0.9, 0.1], [-3.0, -8.0], [1, 1], -1), (4, [0.95, 0.05], [-0.2, -5.0], [1, 1], 1)]
    found = A.outlier_report(spark.createDataFrame(rows, schema)).collect()[0]
    # by confidence: 1 (outlier, before its tie 2), 2, 3 (outlier), 4; by likelihood: 1, 3, 2, 4
    assert abs(found["auprc_posterior"] - (1 + 2 / 3) / 2) < 1e-9 and abs(found["auprc_likelihood"] - 1) < 1e-9
    assert found["false_accept"] == 0.5
    for some in (rows[1:2] + rows[3:], rows[0:1] + rows[2:3], []):
        found = A.outlier_report(spark.createDataFrame(some, schema)).collect()[0]
        assert found["auprc_posterior"] is None and found["auroc_posterior"] is None and found["auprc_likelihood"] is None
