"""Every registered query against its check SQL; queries without one must run and keep their schema."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
QUERIES = {n: q for n, q in QUERIES.items() if not re.match(r"op\d+_|pipeline$", n)}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(df, con, SQL[name]) == []
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
