"""Every registered query with SQL, side by side with DuckDB on the smallest tables."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from docmill.jobs.oracles import oracle_sql
from docmill.jobs.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return ""
        return str(v)[:10] if hasattr(v, "year") else str(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_other_queries_run(spark, name):
    assert queries()[name](spark, SF).count() >= 0
