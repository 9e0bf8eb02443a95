"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["accuracy", "f1"]


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    result = contract.queries()[name](spark, sf_dir)
    assert difference(result, con, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_model_output_has_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0
