"""Every registered query equals its SQL on the whole tables."""

import pytest

import __spark_entry__ as entry
from oracle import TESTDATA, compare, connect
from paperlantern.workload.registry import ORACLES, QUERIES

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    mine, theirs, my_columns, their_columns = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert my_columns == their_columns
    assert mine == theirs
    assert mine


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "index_id", "rank", "path", "score"]
    assert df.count() > 0
