"""Every registered query against its oracle SQL, on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, queries()[name], oracle_sql()[name]) is None


def test_rows_only_queries(spark):
    for name in sorted(set(queries()) - set(oracle_sql())):
        assert queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["tbl", "id", "amt", "kind"]
