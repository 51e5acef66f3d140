"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import os

import duckdb
import pytest

from msgloom.queries.all import ORACLES, QUERIES


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)

        def text(v):
            if v is None or v != v or str(v) in ("NaT", "<NA>"):
                return "NULL"
            if hasattr(v, "year"):
                return str(v)[:10]
            return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

        frame[c] = frame[c].map(text)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    got, want = normal(QUERIES[name](spark, sf_dir).toPandas()), normal(duck.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
