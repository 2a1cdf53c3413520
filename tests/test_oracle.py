"""Every registered query against its SQL twin on the smallest test data."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name) == ""


def test_entry(spark):
    assert "rank" in entry(spark).columns
