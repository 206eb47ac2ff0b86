"""How well scored classes, or the origins' own distributions, tell origins apart: spectra of K x K products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtide.functions.arrays import lists, matrix, summed_rows

#: Origins of the rows of a product that one task computes.
BLOCK = 128
#: Overlaps are compared to so many digits, so that equal ones tie whatever the order of their factors.
DIGITS = 12


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            ll = matrix(batch.column("ll"), None, "ll")
            ll = ll - ll.mean(axis=1, keepdims=True)
            part = (ll * batch.column("n").to_numpy(zero_copy_only=False)[:, None]).T @ ll
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), lists(total)], names=["row", "vec"])


def _spectrum(gram: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh((gram + gram.T) / 2)[::-1]


def score_gram(classes: DataFrame) -> DataFrame:
    """(ll finite, n) -> row, vec: the K x K sum of n times the products of row-centred scores, added up on executors (MT17)."""
    return summed_rows(classes.filter("n > 0").select("ll", "n").mapInArrow(_gram, "row int, vec array<double>"))


def conditioning(classes: DataFrame, tol: float = 1e-12) -> dict:
    """(ll finite, n) -> singular values, rank and condition over the retained ones (MT17); the K x K sum is made on executors."""
    rows = {r["row"]: r["vec"] for r in score_gram(classes).collect()}
    if not rows:
        return {"singular_values": [], "rank": 0, "condition": float("inf")}
    k = len(rows)
    values = np.sqrt(np.clip(_spectrum(np.array([rows[i] for i in range(k)])), 0, None))
    kept = values[values > max(tol**0.5, k * np.finfo(float).eps ** 0.5) * values[0]] if values[0] > 0 else values[:0]
    return {"singular_values": values.tolist(), "rank": len(kept), "condition": float(kept[0] / kept[-1]) if len(kept) else float("inf")}


def _matrix_of(emissions: DataFrame) -> np.ndarray:
    """(origin, q array) of origins 0 .. K - 1 as the K x J matrix that the panel fixes."""
    rows = emissions.select("origin", "q").orderBy("origin").collect()
    q = np.array([r["q"] for r in rows], dtype=float)
    if q.ndim != 2 or not q.size or [r["origin"] for r in rows] != list(range(len(rows))):
        raise ValueError("emissions must be a matrix of origins 0 .. K - 1 by probes")
    if not ((q >= 0) & (q <= 1)).all():
        raise ValueError("emissions must be probabilities")
    return q


def _blocks(emissions: DataFrame, n: int) -> DataFrame:
    """A row, and a task, for every BLOCK origins."""
    tasks = -(-n // BLOCK)
    return emissions.sparkSession.range(0, tasks, 1, tasks).select((F.col("id") * BLOCK).cast("int").alias("block"))


def _close(q: np.ndarray, atol: float, rtol: float):
    """(block) -> origin, near: the earlier origins that a row of the block is close to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("block").to_pylist():
                own = range(first, min(first + BLOCK, len(q)))
                near = [np.flatnonzero((np.abs(q[k] - q[:k]) <= atol + rtol * np.abs(q[:k])).all(axis=1)).tolist() for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(near, pa.list_(pa.int32()))], names=["origin", "near"])

    return run


def close_groups(emissions: DataFrame, atol: float, rtol: float = 0.0) -> DataFrame:
    """(origin, q array) -> first, members: each origin joins the first group whose first member it is close to (AGG14).

    Close is |q - first's q| <= atol + rtol * |first's q| at every probe. Comparisons run in tasks of BLOCK origins; the
    choice goes through the origins in order, as it depends on the groups before.
    """
    if atol < 0 or rtol < 0:
        raise ValueError("tolerances must not be negative")
    q = _matrix_of(emissions)
    near = {r["origin"]: r["near"] for r in _blocks(emissions, len(q)).mapInArrow(_close(q, atol, rtol), "origin int, near array<int>").collect()}
    groups: dict[int, list[int]] = {}
    for k in range(len(q)):
        groups.setdefault(next((r for r in near[k] if r in groups), k), []).append(k)
    return emissions.sparkSession.createDataFrame(list(groups.items()), "first int, members array<int>")


def _products(q: np.ndarray):
    """(block) -> rows of the inner products of the origins' distributions, with each origin's closest later one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("block").to_pylist():
                own = q[first : first + BLOCK]
                gram, alike = np.ones((len(own), len(q))), np.ones((len(own), len(q)))
                for j in range(q.shape[1]):
                    a, b = own[:, j, None], q[None, :, j]
                    gram *= a * b + (1 - a) * (1 - b)
                    alike *= np.sqrt(a * b) + np.sqrt((1 - a) * (1 - b))
                place = first + np.arange(len(own))
                alike[np.arange(len(q))[None, :] <= place[:, None]] = -np.inf
                alike = np.round(alike, DIGITS)
                best = np.argmax(alike, axis=1)
                columns = [pa.array(place, pa.int32()), lists(gram), pa.array(best, pa.int32()), pa.array(alike[np.arange(len(own)), best])]
                yield pa.RecordBatch.from_arrays(columns, names=["origin", "products", "other", "alike"])

    return run


def origin_products(emissions: DataFrame) -> DataFrame:
    """(origin, q array) -> origin, products, other, alike: inner products with all origins' distributions over the outcomes,
    and the later origin, the first of equals, whose distribution overlaps most (MT16).

    Origins must be 0 .. K - 1. K x J probabilities, which the panel fixes, go to the tasks; each makes BLOCK rows.
    """
    q = _matrix_of(emissions)
    return _blocks(emissions, len(q)).mapInArrow(_products(q), "origin int, products array<double>, other int, alike double")


def emission_diagnostics(emissions: DataFrame, tol: float = 1e-10) -> dict:
    """Rank, extreme singular values and condition of the origins' distributions, and their closest pair (MT16).

    Of equally close pairs the first counts. The rank is judged on the squared values; below full rank the condition is infinite.
    """
    if not (np.isfinite(tol) and tol > 0):
        raise ValueError("tol must be positive")
    rows = sorted(origin_products(emissions).collect(), key=lambda r: r["origin"])  # K x K, as the spectrum needs
    squares = _spectrum(np.array([r["products"] for r in rows]))
    rank = int((squares > tol * squares[0]).sum())
    values = np.sqrt(np.clip(squares, 0, None))
    best = max(rows, key=lambda r: (r["alike"], -r["origin"]))
    pair = (best["origin"], best["other"]) if len(rows) > 1 else (0, 0)
    return {
        "rank": rank,
        "origins": len(rows),
        "largest": float(values[0]),
        "least_retained": float(values[rank - 1]) if rank else 0.0,
        "condition": float(values[0] / values[rank - 1]) if rank == len(rows) else float("inf"),
        "minimum_hellinger": float(np.sqrt(max(0.0, 1 - min(1.0, best["alike"])))) if len(rows) > 1 else 0.0,
        "closest_pair": pair,
    }
