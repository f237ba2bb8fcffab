import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, normalised

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "trade_windows",
    "quote_windows",
    "microstructure_metrics",
    "microstructure_lagged",
    "institutional_pressure_basket",
    "subscriber_batches",
    "microstructure_stepped",
    "nearest_points",
    "session_feed",
    "quotations_of_the_last_hour",
    "member_attribution_bear",
    "pushed_batches",
    "replayed_throughput",
    "decoded_trades",
    "daily_bars",
    "calendar",
    "index_members",
    "index_trend",
    "annualised_gain",
    "drawdown_labels",
    "member_attribution",
    "features_forward_two_weeks",
    "financial_quarters",
]


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for table in TABLES.split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return db


def test_every_statement_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, database, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    want = database.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalised(got) == normalised(want)
