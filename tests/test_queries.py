"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import connection, differences
from swellframe.plans.catalog import QUERIES
from swellframe.plans.checks import CHECKS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connection(SF_DIR)
    yield con
    con.close()


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["backend", "success", "failed"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(df, duck, CHECKS[name]) == []
