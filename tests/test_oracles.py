"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from ledgerscope.plans import graph_queries, score_queries, text_queries  # noqa: F401
from ledgerscope.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, con, name):
    a = QUERIES[name](spark, sf).toPandas()
    b = con.sql(SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    kinds = {c: (a[c].dtype.kind, b[c].dtype.kind) for c in columns}
    assert all(x == y or {x, y} == {"i", "f"} and a[c].isna().any() for c, (x, y) in kinds.items()), kinds  # pandas holds longs with nulls as doubles
    for c, (x, y) in kinds.items():
        if x != y:
            a[c], b[c] = a[c].astype(float), b[c].astype('Float64').astype(float)
    a, b = (x[columns].sort_values([c for c in columns if x[c].dtype.kind != "f"] + [c for c in columns if x[c].dtype.kind == "f"]).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)
