"""Every registered query against its SQL."""

import __spark_entry__ as driver
import oracle
import pytest

from polderlake.plans.bindings import QUERIES
from polderlake.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = driver.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(driver.oracle_sql()[name]).df()
    assert oracle.compare(got, want) is None


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
