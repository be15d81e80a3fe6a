"""Every registered query against its check SQL, and none may be empty."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, open_db

# thresholds that the smallest data set does not reach
EMPTY_WHEN_SMALL = {"nxdomain_spam"}
HEAVY = {"train_forest", "score_events", "anomaly_forest", "feature_importance", "row_explanation", "save_load_model"}


@pytest.fixture(scope="module")
def db(small):
    return open_db(small)


@pytest.mark.parametrize("key", [k for k in queries() if k not in HEAVY])
def test_query_matches_sql(spark, small, db, key):
    ok, note = compare(spark, db, small, key, queries()[key], oracle_sql().get(key))
    assert ok or (key in EMPTY_WHEN_SMALL and note.startswith("rows=0")), note


def test_flagship_has_rows_and_a_stable_schema(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == entry(spark).columns


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
