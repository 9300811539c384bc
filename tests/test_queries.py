"""Every registered query against SQL written independently."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from recordloom.plans.oracle import ORACLE
from recordloom.plans.queries import QUERIES
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_is_registered_and_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    check(QUERIES[name](spark, sf_dir), con, ORACLE[name])


def test_entry(spark, sf_dir):
    df = contract.entry(spark)
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
