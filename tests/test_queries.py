"""Every registered query against its SQL, on the smallest data."""

import pytest

from __spark_entry__ import entry
from check_oracle import compare, connect
from workloads.oracle import ORACLE
from workloads.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    assert compare(spark, db, SF_DIR, name) is None


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["table", "o_orderkey", "O_CustKey_id", "O_CustKey_status", "tier", "file_no"]
    assert {(r.O_CustKey_status, r.tier) for r in result.select("O_CustKey_status", "tier").distinct().collect()} == {
        ("resolved", 3)}
