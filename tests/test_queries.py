"""Every query of the catalogue against its SQL in DuckDB, on small tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cohortwave.plans import catalogue

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    got, want = catalogue.queries()[name](spark, D).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    for c in cols:
        if pd.api.types.is_float_dtype(got[c]) or pd.api.types.is_float_dtype(want[c]):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()
