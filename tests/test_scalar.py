from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickwise.functions import scalar


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "value, units, nanos",
    [
        (123.0, 123, 0),
        (123.45, 123, 450_000_000),
        (-123.0, -123, 0),
        (-123.45, -123, -450_000_000),
        (0.000000001, 0, 1),
        (0.0000000005, 0, 1),
        (0.0000000004, 0, 0),
    ],
)
def test_money_split(spark, value, units, nanos):
    row = one(spark, scalar.money_from_number(F.lit(value)).alias("m")).m
    assert (row.units, row.nanos, row.currency) == (units, nanos, "USD")


@pytest.mark.parametrize(
    "units, nanos, amount",
    [
        (0, 0, "0"),
        (0, 1, "0.000000001"),
        (1, 990_000_000, "1.99"),
        (1, 1_000_000_000, "2"),
        (-1, -1, "-1.000000001"),
        (-1, 1, None),
        (1, -1, None),
    ],
)
def test_money_amount(spark, units, nanos, amount):
    got = one(spark, scalar.money_amount(F.lit(units).cast("long"), F.lit(nanos)).alias("a")).a
    assert got == (None if amount is None else Decimal(amount))


def test_rates(spark):
    row = one(
        spark,
        scalar.pct_change(F.lit(110.0), F.lit(100.0)).alias("change"),
        scalar.pct_change(F.lit(110.0), F.lit(0.0)).alias("undefined"),
        scalar.symmetric_rate(F.lit(3.0), F.lit(1.0)).alias("rate"),
        scalar.attribution(F.lit(2.0), F.lit(3.0), 0.5).alias("share"),
        scalar.annualised_rate(F.lit(4.0), F.lit("2017-12-31").cast("timestamp"), "2016-01-01").alias("yearly"),
        scalar.signed_value(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("signed"),
        scalar.sign(F.lit(-0.2)).alias("sign"),
    )
    assert row.change == pytest.approx(10.0)
    assert row.undefined is None
    assert row.rate == pytest.approx(50.0)
    assert row.share == pytest.approx(6.0 / 4.5)
    assert row.yearly == pytest.approx(100.0)
    assert (row.signed, row.sign) == (-5.0, -1)


def test_sets_and_maps(spark):
    row = one(
        spark,
        scalar.split_tickers(F.lit(" AAPL, MSFT ,,")).alias("tickers"),
        scalar.shared_keys(
            F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9), F.lit("c"), F.lit(8))
        ).alias("both"),
        scalar.rename_by({"x": "y"}, F.lit("x")).alias("renamed"),
        scalar.rename_by({"x": "y"}, F.lit("z")).alias("kept"),
        scalar.string_tag(F.lit('{"ticker": "A\\"B"}'), "ticker").alias("tag"),
    )
    assert row.tickers == ["AAPL", "MSFT"]
    assert row.both == {"b": 9}
    assert (row.renamed, row.kept, row.tag) == ("y", "z", 'A"B')
    symbols = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    assert {r.s for r in symbols.filter(scalar.in_scope("s", [], [])).collect()} == {"a", "b", "c"}
    assert {r.s for r in symbols.filter(scalar.in_scope("s", ["a", "b"], ["b", None])).collect()} == {"a"}


def test_epochs(spark):
    values = [1_700_000_000_123_456_789, 1_700_000_000_123_456, 1_700_000_000_123, 1_700_000_000]
    rows = spark.createDataFrame([(v,) for v in values], "t long").select(scalar.epoch_to_millis("t").alias("ms")).collect()
    assert [round(r.ms / 1000) for r in rows] == [1_700_000_000] * 4
    checks = spark.createDataFrame([(0, 0), (1, 999_999_999), (-1, 0), (1, 1_000_000_000)], "s long, n long")
    assert [r.ok for r in checks.select(scalar.timestamp_is_valid("s", "n").alias("ok")).collect()] == [True, True, False, False]
