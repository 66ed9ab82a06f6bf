"""Every registered query with a SQL counterpart gives the same rows."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from factorloom import catalog, oracle
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, oracle.statements()

# split windows, joins of ranges and sketches again, with limits small enough to be reached
SPLIT = ("forward_return", "ts_rank", "ts_family_windows", "fill_gaps", "eval_expression",
         "degenerate_guard", "prepare_features", "profile_target")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


@pytest.mark.parametrize("name", SPLIT)
def test_matches_sql_when_split(spark, con, name):
    limits = {"spark.factorloom.blockRows": "60", "spark.factorloom.exactRows": "0"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) is None
    finally:
        for key in limits:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
