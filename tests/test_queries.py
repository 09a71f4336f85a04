"""Every registered query against its SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(cell(row[i]) for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    found = entry.queries()[name](spark, FOLDER)
    rows = found.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    wanted = oracle.execute(sql)
    names = [column[0] for column in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, rows) == rows_of(names, wanted.fetchall())


def test_entry(spark):
    found = entry.entry(spark)
    assert {"media_id", "index", "speaker", "text"} <= set(found.columns)
    assert found.count() > 0


def test_every_query_has_a_plain_name():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]+", name) for name in entry.queries())
