"""Every registered query against the SQL that states the same result, on the smallest data."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from pulsegrain.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    assert catalogue.FLAGSHIP in entry_module.queries()
    assert set(catalogue.ORACLE_SQL) <= set(entry_module.oracle_sql())
    assert entry_module.entry(spark).count() > 0
