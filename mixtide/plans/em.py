"""Expectation-maximisation over scored classes: partial sums per partition in Arrow batches, a K-vector on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mixtide.functions.arrays import matrix
from mixtide.functions.math import bind, softmax
from mixtide.operators.classes import check_counts, count_classes, drop_invariant_probes, probe_counts
from mixtide.operators.likelihood import check_q, emission_matrix, score


#: Numbers of all partitions' sums (8 bytes each) up to which they meet on the driver; beyond it executors add them up first.
DIRECT = 1 << 20
#: Numbers that a task of a step takes; steps over fewer run in fewer tasks than the cached input has partitions.
STEP = 1 << 20


def step_tasks(rows: DataFrame, numbers: int) -> int:
    """Tasks for one pass over so many numbers of cached rows, at most one per partition."""
    return max(1, min(rows.rdd.getNumPartitions(), math.ceil(numbers / STEP)))


@dataclass
class Fit:
    weights: np.ndarray
    expected_counts: np.ndarray
    history: list[float]
    converged: bool
    n_iter: int
    diagnostics: dict = field(default_factory=dict)


def _partial(weights: np.ndarray):
    """One row per partition: sums of n * posterior and of n * log-likelihood."""
    with np.errstate(divide="ignore"):
        logs = np.log(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, value = np.zeros(len(logs)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            ll = matrix(batch.column("ll"), len(logs), "ll") + logs
            top = ll.max(axis=1)
            if not np.isfinite(top).all():
                raise ValueError("a class has no origin of positive weight and likelihood")
            p = np.exp(ll - top[:, None])
            size = p.sum(axis=1)
            total += (n / size) @ p
            value += float(n @ (top + np.log(size)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([value])], names=["expected", "value"])

    return run


def sum_arrays(rows: DataFrame, column: str) -> np.ndarray:
    """The sum over all rows of an array column of one length, entry by entry, on executors; one array comes back."""
    sums = rows.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(sums))
    for r in sums:
        out[r["k"]] = r["x"]
    return out


def e_step(classes: DataFrame, weights: np.ndarray, direct: bool = False) -> tuple[np.ndarray, float]:
    """Expected counts and log-likelihood of (n, ll) classes at fixed weights (EM1, EM2). K + 1 numbers come back.

    direct: the partitions' sums meet on the driver, which saves a shuffle where they are few.
    """
    rows = classes.select("n", "ll").mapInArrow(_partial(weights), "expected array<double>, value double")
    if direct:
        found = rows.collect()
        return np.sum([r["expected"] for r in found], axis=0), float(sum(r["value"] for r in found))
    sums = sum_arrays(rows.select(F.concat("expected", F.array("value")).alias("sums")), "sums")
    return (sums[:-1], float(sums[-1])) if len(sums) else (np.zeros(len(weights)), 0.0)


def objective(classes: DataFrame, weights: list[float]) -> float:
    """Log-likelihood of (n, ll) classes under a fixed mixture (EM14); classes of count 0 add nothing."""
    w = np.asarray(weights, float)
    if w.ndim != 1 or not np.isfinite(w).all() or (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must be finite and non-negative, with a positive sum")
    return e_step(classes.filter("n > 0"), w / w.sum())[1]


def fit(classes: DataFrame, initial: list[float] | None = None, max_iter: int = 1000, tol: float = 1e-8, offset: float = 0.0) -> Fit:
    """Mixture weights of (n, ll) classes (EM3, EM4). Flat rows take no part in the loop and get their share at the end.

    Converged when the likelihood moves by at most tol * (1 + its size) and no weight by more than tol. Counts must be whole
    and at least 0; of classes with a positive one, ll must hold finite numbers or -Infinity, one of them finite, and be of
    one length. A column log_offset is added to the likelihood. The input is computed once, into the cache, and checked there.
    """
    if max_iter < 1 or not (np.isfinite(tol) and tol >= 0):
        raise ValueError("max_iter must be positive, tol finite and at least 0")
    if initial is not None and not (np.isfinite(initial).all() and np.min(initial) >= 0 and np.sum(initial) > 0):
        raise ValueError("initial weights must be finite and non-negative, with a positive sum")
    n, infinite = F.col("n"), F.lit("Infinity").cast("double")
    wrong = ~F.coalesce((n >= 0) & (n == F.floor(n)), F.lit(False))
    bad = F.coalesce(F.size("ll") < 1, F.lit(True)) | F.exists("ll", lambda x: x.isNull() | F.isnan(x) | (x == infinite))
    shifted = bind(F.array_max("ll"), lambda top: F.transform("ll", lambda x: x - top))
    own = F.col("log_offset") if "log_offset" in classes.columns else F.lit(0.0)
    rows = classes.filter(wrong | (n > 0)).select("n", wrong.alias("wrong"), F.coalesce(bad, F.lit(True)).alias("bad"), own.alias("own"), F.array_max("ll").alias("top"), shifted.alias("ll"))
    wide = rows.withColumn("flat", F.array_min("ll") == F.array_max("ll")).cache()
    top = F.col("top")
    head = wide.agg(
        F.count("*").alias("rows"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("flat"), n).otherwise(0)).alias("flat"),
        F.sum(n * top + F.col("own")).alias("offset"),
        F.min(F.size("ll")).alias("least"),
        F.max(F.size("ll")).alias("k"),
        F.max("wrong").alias("wrong"),
        F.max(F.col("bad") | (top == -infinite)).alias("bad"),
    ).first()
    try:
        if head["wrong"]:
            raise ValueError("counts must be finite non-negative integers")
        if not head["n"]:
            raise ValueError("counts must have a positive sum")
        if head["bad"] or head["least"] != head["k"]:
            raise ValueError("log-likelihoods must be finite or -Infinity, with support for every row, and of one length")
        if initial is not None and len(initial) != head["k"]:
            raise ValueError("initial weights must have one entry per origin")
        tasks = step_tasks(wide, head["rows"] * head["k"])
        return _loop(wide.filter("not flat").coalesce(tasks), head, initial, max_iter, tol, offset, tasks * (head["k"] + 1) <= DIRECT)
    finally:
        wide.unpersist()


def _loop(informative: DataFrame, head: Row, initial: list[float] | None, max_iter: int, tol: float, offset: float, direct: bool) -> Fit:
    k, total, flat = head["k"], float(head["n"]), float(head["flat"])
    w = np.full(k, 1.0 / k) if initial is None else np.asarray(initial, float) / np.sum(initial)
    history, converged, n_iter, expected = [0.0], True, 0, np.zeros(k)
    if total > flat:
        expected, value = e_step(informative, w, direct)
        history, converged = [value], False
        for n_iter in range(1, max_iter + 1):
            new = expected / expected.sum()
            expected, value = e_step(informative, new, direct)
            move, gain = np.abs(new - w).max(), abs(value - history[-1])
            w = new
            history.append(value)
            if gain <= tol * (1 + abs(value)) and move <= max(tol, np.finfo(float).eps):
                converged = True
                break
    gains = np.diff(history)
    diagnostics = {
        "n_uninformative": flat,
        "monotonic": bool((gains >= -1e-10 * (1 + np.abs(history[:-1]))).all()) if len(gains) else True,
        "terminal_em_residual": float(np.abs(expected / expected.sum() - w).max()) if total > flat else 0.0,
    }
    return Fit(w, expected + flat * w, [h + (head["offset"] or 0.0) + offset for h in history], converged, n_iter, diagnostics)


def fit_em(
    traces: DataFrame,
    q: list[list[float]] | None = None,
    schedule: DataFrame | None = None,
    initial: list[float] | None = None,
    max_iter: int = 1000,
    tol: float = 1e-8,
    profiles: list[list[int]] | None = None,
    alpha: list[float] | float | None = None,
    beta: list[float] | float | None = None,
) -> Fit:
    """Weights of the origins of q, or of binary profiles with rates alpha and beta, from one of three inputs (EM5).

    (molecule, probe, call) rows, with a schedule (cycle, probe) also (molecule, cycle, call) rows: calls are checked,
    counted per probe and reduced to classes. (observed, positive, n) classes: used as they are. (n, ll) classes:
    supplied likelihoods, q and profiles are not used. Probes whose rates are alike for all origins add an offset alone.
    """
    if "ll" in traces.columns:
        return fit(traces, initial, max_iter, tol)
    if (q is None) == (profiles is None) or (q is None) != (alpha is not None and beta is not None):
        raise ValueError("give either q, or profiles with alpha and beta")
    q = emission_matrix(profiles, alpha, beta) if q is None else q
    check_q(q)
    n_probes, found = len(q[0]), traces
    if "observed" not in traces.columns:
        cells = traces
        if schedule is not None:
            known = schedule.select("cycle", F.col("probe").cast("int").alias("probe"))
            if known.groupBy("cycle").count().filter("count > 1").count() or known.filter("probe is null or probe < 0").count():
                raise ValueError("a schedule has one probe for each cycle")
            cells = traces.drop("probe").join(F.broadcast(known), "cycle", "left")  # a cycle without a probe fails the check of probes
        found = count_classes(probe_counts(cells, n_probes))
    else:
        found = check_counts(found, n_probes).filter("n > 0")
    kept, keep, _ = drop_invariant_probes(found, q)
    if not keep:
        return fit(kept.withColumn("ll", F.array_repeat(F.lit(0.0), len(q))), initial, max_iter, tol)
    return fit(score(kept, [[row[j] for j in keep] for row in q]), initial, max_iter, tol)


def posterior(ll: Column, weights: list[float]) -> Column:
    """Posterior over origins at fixed weights (EM6); with equal weights the flat one (EM9)."""
    logs = F.array(*[F.lit(math.log(w)) if w > 0 else F.lit("-Infinity").cast("double") for w in weights])
    return softmax(F.zip_with(ll, logs, lambda x, y: x + y))


def hard_counts(classes: DataFrame, split_ties: bool = True) -> DataFrame:
    """origin, count: each class goes to its likeliest origins, ties split evenly or to the first (EM7)."""
    place = F.posexplode(bind(F.array_max("ll"), lambda top: F.transform("ll", lambda x: x == top))).alias("origin", "best")
    ties = bind(F.array_max("ll"), lambda top: F.size(F.filter("ll", lambda x: x == top)))
    if not split_ties:
        return classes.select((F.array_position("ll", F.array_max("ll")) - 1).cast("int").alias("origin"), "n").groupBy("origin").agg(F.sum("n").cast("double").alias("count"))
    return classes.select("n", ties.alias("ties"), place).filter("best").groupBy("origin").agg(F.sum(F.col("n") / F.col("ties")).alias("count"))


def soft_counts(classes: DataFrame, n_origins: int) -> DataFrame:
    """One E-step from uniform weights (EM8), without Python."""
    post = posterior(F.col("ll"), [1.0 / n_origins] * n_origins)
    return classes.select("n", F.posexplode(post).alias("origin", "p")).groupBy("origin").agg(F.sum(F.col("n") * F.col("p")).alias("count"))
