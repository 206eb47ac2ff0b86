"""Pairs of points in the n-gram join: each is found once, in however many cells it meets."""

import itertools

import numpy as np
import pytest

from mixtide.llm import ngram_join as N
from mixtide.llm._common import Tables


@pytest.mark.parametrize("wide", [1024, 20])
def test_pairs_are_made_once(spark, monkeypatch, wide):
    monkeypatch.setattr(N, "PAGE", 8)
    monkeypatch.setattr(N, "FAN", 3)
    monkeypatch.setattr(N, "WIDE", wide)
    made, whole = spark.sparkContext.accumulator(0), N._meet

    def counted(percent):
        run = whole(percent)

        def each(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return each

    monkeypatch.setattr(N, "_meet", counted)
    counts = np.zeros((30, N.FOLD), dtype="<u2")
    counts[:, :40] = 1
    vectors = spark.createDataFrame([(p, bytearray(counts[p].tobytes()), list(range(40))) for p in range(30)], "point long, counts binary, members array<long>")
    cells = {-7: range(10), 3: range(20), 11: range(5, 28), 12: range(3, 28), 90: range(28), 95: (1, 28, 29)}
    rows = spark.createDataFrame([(leaf, p, 40, p) for leaf, points in cells.items() for p in points], "leaf long, point long, n int, label long")
    with Tables(spark) as tables:
        found = [(r.a, r.b) for r in N._search(rows, vectors, 85, tables).collect()]
    assert sorted(found) == sorted({pair for points in cells.values() for pair in itertools.combinations(points, 2)})
    assert made.value == len(found)
