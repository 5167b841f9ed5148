"""Every query with SQL gives the rows that DuckDB gives; the others give some."""

import os

import pytest
from compare import rows_of, rows_of_sql
from veracel.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = rows_of(QUERIES[name](spark, SF))
    if name in SQL:
        assert got == rows_of_sql(SQL[name], SF)
    else:
        assert got[1]  # rows; what they hold is tested elsewhere


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
