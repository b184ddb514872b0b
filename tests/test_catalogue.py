"""Each registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from gridloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(v)[:10] if hasattr(v, "isoformat") else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, small, name):
    got, want = plain(catalogue.queries()[name](spark, small).toPandas()), plain(duck.execute(catalogue.oracle_sql()[name]).df())
    for c in want.columns:
        if want[c].dtype.kind == "M" and (got[c].dtype == object):
            want[c] = want[c].dt.strftime("%Y-%m-%d")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
