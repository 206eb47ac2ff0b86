"""Several likelihoods of the same classes fitted in the same passes: shifted panels, and gated against naive fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtide.functions.arrays import lists, matrix, sum_rows
from mixtide.operators.likelihood import check_q, condition_on_gate, score
from mixtide.operators.selection import effective_yield
from mixtide.plans.em import Fit


def _sums(weights: np.ndarray, active: np.ndarray):
    """A row per active panel and partition: expected counts of the origins, and the log-likelihood."""
    with np.errstate(divide="ignore"):
        logs = np.log(weights)
    m, k = logs.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(active), k + 1))
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            ll = matrix(batch.column("ll"), m * k, "ll").reshape(-1, m, k)
            for row, panel in enumerate(active):
                x = ll[:, panel] + logs[panel]
                top = x.max(axis=1, keepdims=True, initial=-np.inf)
                if not np.isfinite(top).all():
                    raise ValueError("a class has no origin of positive weight and likelihood")
                p = np.exp(x - top)
                size = p.sum(axis=1)
                total[row, :-1] += (n / size) @ p
                total[row, -1] += n @ (top[:, 0] + np.log(size))
        yield pa.RecordBatch.from_arrays([pa.array(active, pa.int32()), lists(total)], names=["row", "vec"])

    return run


def fit_panels(classes: DataFrame, panels: int, initial: list[float] | None = None, max_iter: int = 1000, tol: float = 1e-8) -> list[Fit]:
    """(n, ll) classes whose ll has the scores of several panels one after the other -> a fit for each, from the same start.

    Every pass over the classes serves all panels that have not converged yet; the rule is that of em.fit.
    """
    if max_iter < 1 or not (np.isfinite(tol) and tol >= 0):
        raise ValueError("max_iter must be positive, tol finite and at least 0")
    used = classes.filter("n > 0").select("n", "ll").cache()
    try:
        head = used.agg(F.max(F.size("ll")).alias("size"), F.sum("n").alias("n")).first()
        if not head["n"]:
            raise ValueError("counts must have a positive sum")
        k = head["size"] // panels
        w = np.tile(np.full(k, 1.0 / k) if initial is None else np.asarray(initial, float) / np.sum(initial), (panels, 1))
        history: list[list[float]] = [[] for _ in range(panels)]
        expected, done, steps = np.zeros((panels, k)), np.zeros(panels, bool), np.zeros(panels, int)
        for turn in range(max_iter + 1):
            active = np.flatnonzero(~done)
            found = sum_rows(used.mapInArrow(_sums(w, active), "row int, vec array<double>"))
            for p in active:
                old, value = (w_before[p] if turn else w[p]), found[p][-1]
                expected[p] = found[p][:-1]
                history[p].append(float(value))
                if turn:
                    steps[p] = turn
                    gain, move = abs(value - history[p][-2]), np.abs(w[p] - old).max()
                    done[p] = gain <= tol * (1 + abs(value)) and move <= max(tol, np.finfo(float).eps)
            if done.all() or turn == max_iter:
                break
            w_before = w.copy()
            w[~done] = expected[~done] / expected[~done].sum(axis=1, keepdims=True)
        return [Fit(w[p], expected[p], history[p], bool(done[p]), int(steps[p])) for p in range(panels)]
    finally:
        used.unpersist()


def shifted_panel(q: list[list[float]], probe: int, shift: float) -> list[list[float]]:
    """q with one probe's probabilities moved by shift on the logit; 0 and 1 stay."""
    with np.errstate(divide="ignore"):
        x = np.array(q, float)
        odds = x[:, probe] / (1 - x[:, probe])
        moved = odds * np.exp(shift)
    x[:, probe] = np.where(np.isinf(moved), 1.0, moved / (1 + np.where(np.isinf(moved), 0.0, moved)))
    return x.tolist()


def probe_sensitivity(
    classes: DataFrame,
    q: list[list[float]],
    probe: int,
    weights: list[float],
    shifts: tuple[float, ...] = (0.05, -0.05),
    max_iter: int = 1000,
    tol: float = 1e-8,
) -> DataFrame:
    """(observed, positive, n) -> shift, tv, converged, n_iter: how far the fit moves when one probe's panel does (MT18).

    All shifted panels are scored in one matrix product and refitted in the same passes, from the given weights.
    """
    check_q(q)
    stacked = [row for s in shifts for row in shifted_panel(q, probe, s)]
    fits = fit_panels(score(classes, stacked), len(shifts), weights, max_iter, tol)
    base = np.asarray(weights, float) / np.sum(weights)
    rows = [(float(s), float(np.abs(f.weights - base).sum() / 2), f.converged, f.n_iter) for s, f in zip(shifts, fits, strict=True)]
    return classes.sparkSession.createDataFrame(rows, "shift double, tv double, converged boolean, n_iter int")


def gated_fits(accepted: DataFrame, q: list[list[float]], visibility: list[float], recovery: list[float], max_iter: int = 1000, tol: float = 1e-8) -> DataFrame:
    """Classes (observed, positive, n) of the molecules that a gate let through -> origin, naive, accepted, source (YD9).

    naive leaves the gate out of the likelihood; accepted conditions on it (ll - ln visibility, YD5), both as shares of
    the accepted molecules; source divides accepted by the yield recovery * visibility (YD1) and normalises. Both fits run
    in the same passes. Visibilities and recoveries must be positive.
    """
    if min(visibility) <= 0 or min(recovery) <= 0:
        raise ValueError("visibilities and recoveries must be positive")
    both = score(accepted, q).withColumn("ll", F.concat("ll", condition_on_gate(F.col("ll"), visibility)))
    naive, kept = fit_panels(both, 2, None, max_iter, tol)
    rows = [(o, float(a), float(b), float(v), float(r)) for o, (a, b, v, r) in enumerate(zip(naive.weights, kept.weights, visibility, recovery, strict=True))]
    found = accepted.sparkSession.createDataFrame(rows, "origin int, naive double, accepted double, v double, r double")
    share = F.col("accepted") / effective_yield(F.col("r"), F.col("v"))
    total = found.agg(F.sum(share).alias("total"))
    return found.crossJoin(F.broadcast(total)).select("origin", "naive", "accepted", (share / F.col("total")).alias("source"))  # a row per origin, and one
