"""Every registered core query that has SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

from mixtide import assignment_queries, model_queries  # noqa: F401
from mixtide import queries as core

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(core.ORACLE[name]).df(), core.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
