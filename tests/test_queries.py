"""Every query of the core that SQL can express, against DuckDB over the same files."""

import os

import duckdb
import pytest

from geotrail.plans import registry


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    answer = duck.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(answer.description)}
    assert sorted(at) == columns
    want = [tuple(plain(r[at[c]]) for c in columns) for r in answer.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found"} <= set(entry.queries())
    assert entry.entry(spark).count() > 0
