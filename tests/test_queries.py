"""Every registered query beside its SQL, over the smallest test tables."""

import importlib.util
import os

import pytest

from oracle import ORACLES
from fixtures.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("compare", f"{ROOT}/tools/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def duck():
    connection = compare.connect(SMALL)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])) == []


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 150
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
