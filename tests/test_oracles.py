"""Every registered query against its oracle on the smallest data."""

import pytest

import __spark_entry__ as contract
import check
from oracles import sql
from termtide.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return check.open_tables(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == sql.oracle_sql().keys()


def test_contract_names_every_query():
    assert contract.queries().keys() >= QUERIES.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, tables, name):
    assert check.spark_rows(spark, SF_DIR, name) == check.oracle_rows(tables, name)


def test_entry(spark):
    top = contract.entry(spark)
    assert top.columns == ["word", "score"] and 0 < top.count() <= 100
