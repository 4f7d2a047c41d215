"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, name):
    rows, problem = compare(spark, queries()[name], SQL[name], FOLDER)
    assert problem == ""
    assert rows >= 0


def test_every_query_has_sql():
    """All but corpus operators that SQL cannot express; their own tests are beside them."""
    corpus = re.compile(r"op\d+_|pipeline$")
    assert {name for name in queries() if not corpus.match(name)} <= set(SQL)


def test_entry(spark):
    assert entry(spark).count() > 0
