"""Every registered query against its DuckDB twin."""

import pytest
from compare import check

import __spark_entry__ as entry
from dnsflow.plans.catalog import QUERIES
from dnsflow.plans.oracle import ORACLE
from conftest import SF


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, text = check(spark, SF, name)
    assert ok, text


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 55 and df.count() > 0
