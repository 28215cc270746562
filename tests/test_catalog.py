"""Every query beside its SQL counterpart on the smallest data folder."""

import compare
import pytest

from __spark_entry__ import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    _, _, problem = compare.compare(spark, connection, name, queries()[name], SQL.get(name), SF_DIR)
    assert problem is None
