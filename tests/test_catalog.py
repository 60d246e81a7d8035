"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from termloom.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and np.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_like_sql(spark, data, con, name):
    got, want = catalog.queries()[name](spark, data).toPandas(), con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
