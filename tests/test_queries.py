"""Every registered query beside its SQL twin, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from compare import compare, connect
from wordloom.plans.catalog import QUERIES
from wordloom.plans.oracles import ORACLES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_all_queries_have_twins():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    _, rows, problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert problem is None and rows > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["id", "word", "cnt", "is_special", "is_infrequent"] and df.count() == 5000
