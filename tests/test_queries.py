"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'; SET max_temp_directory_size = '1GB'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else value)
    return value


def as_rows(columns, data):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted(([plain(r[i]) for i in place] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, sql, name):
    got = driver.queries()[name](spark, FOLDER)
    data = [tuple(r) for r in got.collect()]
    oracle = driver.oracle_sql().get(name)
    if oracle is None:
        assert data
        return
    cursor = sql.execute(oracle)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert as_rows(got.columns, data) == as_rows(columns, cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_names_match():
    assert set(driver.oracle_sql()) <= set(driver.queries())
