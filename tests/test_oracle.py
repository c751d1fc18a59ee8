"""Every query with SQL returns what the SQL returns on the smallest tables."""

import pytest

from rainloom.catalog import oracle_sql, queries
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert check(spark, con, SF, name, queries()[name], oracle_sql()[name]) is None


def test_names_agree():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["rf_score", "champion_test_metrics", "seasonal_daily", "transfer_eval"])
def test_model_queries_have_rows(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.01").count() > 0
