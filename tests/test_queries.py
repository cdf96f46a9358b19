import pytest
from offerwatch import catalog
from oracle import compare, connect

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_of_the_catalog_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


# the queries of other packages have SQL only where SQL can state them
@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    problem, _ = compare(spark, con, SF_DIR, contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
