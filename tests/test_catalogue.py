"""Every registered query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_is_its_sql(spark, duck, sf_dir, name):
    df = entry_points.queries()[name](spark, sf_dir)
    want = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, rows = ordered(df.columns, df.collect()), ordered(want.columns, want.fetchall())
    assert len(got) == len(rows) > 0
    assert got == rows


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
