"""Likelihoods of probe counts whose repeats share an effect (AGG8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mixtide.functions.arrays import lists, matrix
from mixtide.operators.likelihood import check_q

NODES = 64


def quadrature(nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the mean over a standard normal, by Gauss and Hermite."""
    x, w = np.polynomial.hermite.hermgauss(nodes)
    return np.sqrt(2.0) * x, w / np.sqrt(np.pi)


def marginal_intercepts(q: np.ndarray, sigma: float, nodes: int = NODES) -> np.ndarray:
    """The b for which the mean of expit(b + sigma * z) over standard normal z is q, entry by entry, by halving intervals.

    q of 0 and 1 give -infinity and infinity.
    """
    z, w = quadrature(nodes)
    q = np.asarray(q, float)
    low, high = np.full(q.shape, -40.0 - 10 * sigma), np.full(q.shape, 40.0 + 10 * sigma)
    for _ in range(80):
        middle = (low + high) / 2
        under = (1 / (1 + np.exp(-(middle[..., None] + sigma * z)))) @ w < q
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(q <= 0, -np.inf, np.where(q >= 1, np.inf, (low + high) / 2))


def _scores(q: list[list[float]], sigma: float, nodes: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, w = quadrature(nodes)
        at = marginal_intercepts(np.asarray(q, float).T, sigma, nodes)[..., None] + sigma * z  # probes, origins, nodes
        with np.errstate(divide="ignore"):
            yes, no, weight = -np.logaddexp(0, -at), -np.logaddexp(0, at), np.log(w)
        known: dict[tuple[int, int, int], np.ndarray] = {}

        def of(j: int, seen: int, hit: int) -> np.ndarray:
            """Over origins, the logarithm of the mean chance of hit positive calls of seen ones."""
            if (j, seen, hit) not in known:
                part = (yes[j] * hit if hit else 0.0) + (no[j] * (seen - hit) if seen > hit else 0.0) + weight
                top = part.max(axis=-1, keepdims=True)
                top = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    known[j, seen, hit] = top[:, 0] + np.log(np.exp(part - top).sum(axis=-1)) if seen else np.zeros(len(q))
            return known[j, seen, hit]

        for batch in batches:
            if len(known) > 10_000:  # of 8 bytes an origin each
                known.clear()
            seen, hit = (matrix(batch.column(c), len(yes), c) for c in ("observed", "positive"))
            if (hit < 0).any() or (hit > seen).any() or (seen != np.floor(seen)).any() or (hit != np.floor(hit)).any():
                raise ValueError("counts must be whole, with 0 <= positive <= observed")
            ll = np.zeros((batch.num_rows, len(q)))
            for j in range(len(yes)):
                cells, rows = np.unique(np.stack([seen[:, j], hit[:, j]], axis=1).astype(int), axis=0, return_inverse=True)
                ll += np.array([of(j, s, h) for s, h in cells.tolist()]).reshape(-1, len(q))[rows.ravel()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists(ll)], names=[*columns, "ll"])

    return run


def score_repeat_aware(classes: DataFrame, q: list[list[float]], sigma: float, nodes: int = NODES) -> DataFrame:
    """classes (observed, positive) with ll, where the calls of one probe share a normal effect of deviation sigma on the logit.

    The chance of an (origin, probe) is q on the mean over the effect; the mean is taken at `nodes` quadrature nodes, once
    for each (probe, observed, positive) that a task meets. At sigma 0 ll is that of independent calls. Wrong counts are errors.
    """
    check_q(q)
    if not (np.isfinite(sigma) and sigma >= 0):
        raise ValueError("sigma must be finite and at least 0")
    plain = classes.drop("ll")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in plain.dtypes), "ll array<double>"])
    return plain.mapInArrow(_scores(q, float(sigma), nodes, plain.columns), schema)
