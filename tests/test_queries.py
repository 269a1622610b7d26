"""Registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as driver

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["kg_edges", "cond_ops", "templates", "fifo_join", "fw_params", "web_errors", "rule_state", "many_roles", "folder_rollup", "time_scalars"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, tables, name):
    found = driver.queries()[name](spark, SF)
    columns = sorted(found.columns)
    cursor = tables.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert Counter(tuple(row[c] for c in columns) for row in found.collect()) == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0
