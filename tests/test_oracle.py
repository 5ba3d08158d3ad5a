import pytest

from peakloom.plans.analogues import ORACLE, QUERIES, flagship

from .compare import assert_same, connect
from .conftest import DATA


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert assert_same(spark, con, DATA, QUERIES[name], ORACLE[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0
