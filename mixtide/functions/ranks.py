"""Sums over all rows in front of a row, without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtide.session import use_checkpoints


def _running(values: tuple[str, ...]):
    """Adds the sums over the rows in front, inside a partition, in the order of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = dict.fromkeys(values, 0)
        for batch in batches:
            added = []
            for v in values:
                x = batch.column(v).fill_null(0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(x) + carry[v]
                added.append(pa.array(upto - x))
                carry[v] = upto[-1] if len(upto) else carry[v]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f"before_{v}" for v in values)])

    return run


def running_totals(rows: DataFrame, order: list[Column], *values: str) -> DataFrame:
    """rows with before_<value>: the sum of value over the rows in front of each in the given order.

    One range shuffle; sums inside its sorted partitions, plus the totals of the partitions in front (one row each). The
    ranged rows are checkpointed, so that they are the same where they are totalled and where they are summed. The order must
    tell rows apart; null values count as 0.
    """
    use_checkpoints(rows.sparkSession)
    whole = rows.select(*(c for c in rows.columns if c not in values), *(F.col(v).cast("double" if t in ("float", "double") else "bigint").alias(v) for v, t in rows.dtypes if v in values))
    ranged = whole.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    schema = ", ".join(f"`{c}` {t}" for c, t in [*ranged.dtypes, *((f"before_{v}", dict(ranged.dtypes)[v]) for v in values)])
    inside = ranged.mapInArrow(_running(values), schema)
    past = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = ranged.groupBy("__part").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    totals = totals.select("__part", *[F.coalesce(F.sum(v).over(past), F.lit(0)).alias(f"__{v}") for v in values])
    met = inside.join(F.broadcast(totals), "__part")
    return met.select(*rows.columns, *((F.col(f"before_{v}") + F.col(f"__{v}")).alias(f"before_{v}") for v in values))
