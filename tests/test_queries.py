import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from review_trust.plans.oracles import oracles
from review_trust.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"iforest_trust", "full_run"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert differences(QUERIES[name](spark, SF_DIR).toPandas(), db.sql(SQL[name]).df()) == []


def test_full_run(spark):
    rows = QUERIES["full_run"](spark, SF_DIR).collect()
    assert sorted((r.metric, r.k) for r in rows) == [(m, k) for m in ("Precision", "nDCG") for k in (5, 10, 20)]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "rank", "parent_asin", "score"] and df.count() > 0
