"""Every query that has SQL, against DuckDB on the smallest tables; all others must run."""

import pytest
from conftest import DATA

from seqloom.plans.registry import ORACLE_SQL, QUERIES


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("float"):
            df[c] = df[c].round(6)
        elif kind.lower().startswith(("int", "uint")):
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    import pandas as pd

    ours, theirs = plain(QUERIES[name](spark, DATA).toPandas()), plain(duck.execute(ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11
    assert set(e.oracle_sql()) <= set(e.queries())
