"""Connected components of an edge table, by contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtide.llm._common import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(a, b) long edges -> (id, label): label is one id of the component. No edges: no rows. Loops and nulls are ignored.

    Each round maps every node to the smallest of itself and its neighbours and contracts the graph by that map, until
    no edge is left; a star is gone after one round, and ids that are hashes shrink a path by a constant factor. The
    maps are then applied one after the other. The tables belong to the caller, nothing is collected.
    """
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, maps = tables.write(ordered, "edges"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = tables.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "low")
        maps.append(low)
        near = left.join(low.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(low.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
        left = tables.write(near.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("label"))
    out = maps[0]
    for low in maps[1:]:
        out = out.join(low.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return tables.write(out, "labels")
