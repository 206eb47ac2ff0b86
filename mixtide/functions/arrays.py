"""Arrow batches of array columns as matrices, with their shape checked row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array, width: int | None, name: str) -> np.ndarray:
    """An array column as rows of a float matrix. Null rows, null entries and rows of another width are errors.

    width None takes that of the first row.
    """
    if not len(column):
        return np.zeros((0, width or 0))
    if column.null_count:
        raise ValueError(f"{name} is null in a row")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes[0]) if width is None else width
    if (sizes != width).any():
        raise ValueError(f"{name} must have {width} entries in every row")
    entries = column.flatten()
    if entries.null_count:
        raise ValueError(f"{name} has a null entry")
    return entries.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A matrix as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def _summed(table: pa.Table) -> pa.Table:
    return pa.table({"row": table["row"].slice(0, 1), "vec": lists(matrix(table["vec"].combine_chunks(), None, "vec").sum(axis=0, keepdims=True))})


def summed_rows(rows: DataFrame) -> DataFrame:
    """(row, vec) -> the sum of each row's arrays, on executors."""
    return rows.groupBy("row").applyInArrow(_summed, "row int, vec array<double>")


def sum_rows(rows: DataFrame, direct: bool = False) -> dict[int, np.ndarray]:
    """summed_rows on the driver: as many arrays come back as there are rows.

    direct: the partitions' arrays meet on the driver, which saves a shuffle where they are few.
    """
    if not direct:
        return {r["row"]: np.array(r["vec"]) for r in summed_rows(rows).collect()}
    sums: dict[int, np.ndarray] = {}
    for r in rows.collect():
        sums[r["row"]] = sums.get(r["row"], 0.0) + np.array(r["vec"])
    return sums
