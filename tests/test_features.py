import gzip
import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickwise.operators import quality
from tickwise.plans import features as feat


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [
        (date(2020, 1, 1) + timedelta(i), rng.uniform(80, 100), *[rng.uniform(-1, 1) for _ in range(4)], rng.uniform(80, 100), *[rng.randint(0, 9) for _ in range(4)], rng.uniform(10, 40))
        for i in range(60)
    ]
    kinds = ["double"] * 6 + ["int"] * 4 + ["double"]
    names = feat.NEXT_BANK_DAY.columns
    return spark.createDataFrame(rows, "day date, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).cache()


def test_export(table, tmp_path):
    feat.export_csv(table, feat.NEXT_BANK_DAY, str(tmp_path), "run1", hold_out=10)
    for copy in ("run1", "latest"):
        files = sorted((Path(tmp_path) / feat.NEXT_BANK_DAY.name / copy).glob("part-*.gz"))
        lines = [line for f in files for line in gzip.open(f, "rt").read().splitlines()]
        assert len(lines) == 50
        assert all(len(line.split(",")) == 11 for line in lines)
    labels = {float(line.split(",")[0]) for line in lines}
    first = {r[0] for r in table.orderBy("day").limit(50).select("drawdown_next_bank_day").collect()}
    assert labels == first


def test_points(table):
    line = feat.feature_lines(table, feat.NEXT_BANK_DAY).first().value
    name, body, ts = line.split(" ")
    assert name == "drawdown-next-bank-day-training-data-"
    assert "days_since_dip_of_3=" in body and body.split("days_since_dip_of_3=")[1].split(",")[0].endswith("i")
    assert ts.endswith("000000000")


def test_train_save_load_predict(table, tmp_path):
    model = feat.train(table, feat.NEXT_BANK_DAY, rounds=2, depth=2)
    feat.save_model(model, str(tmp_path), feat.NEXT_BANK_DAY, "m1")
    loaded = feat.load_model(str(tmp_path), feat.NEXT_BANK_DAY)
    a = feat.predict(table, model, feat.NEXT_BANK_DAY).orderBy("day").collect()
    b = feat.predict(table, loaded, feat.NEXT_BANK_DAY).orderBy("day").collect()
    assert a == b and len(a) == 60
    assert a[0].measurement == "drawdown-next-bank-day-prediction-results"
    assert feat.FORWARD_FIVE_WEEKS.result_measurement == "forward-max-drawdown-prediction-results-five-weeks"


def test_training_again_gives_the_same_model(table):
    runs = [feat.predict(table, feat.train(table, feat.NEXT_BANK_DAY, rounds=3), feat.NEXT_BANK_DAY).orderBy("day").collect() for _ in range(2)]
    assert runs[0] == runs[1]


def test_hold_out_of_one_series(spark):
    df = spark.createDataFrame([(date(2020, 1, 1) + timedelta(i),) for i in range(9)], "day date")
    assert sorted(r.day.day for r in quality.hold_out_tail(df, 4).collect()) == [1, 2, 3, 4, 5]
    assert quality.hold_out_tail(df, 0).count() == 9 and quality.hold_out_tail(df, 20).count() == 0


def test_hold_out_per_series(spark):
    df = spark.createDataFrame([(s, date(2020, 1, 1) + timedelta(i)) for s in "ab" for i in range(5)], "s string, day date")
    assert quality.hold_out_tail(df, 3, keys=["s"]).count() == 4
    assert quality.hold_out_tail(df.filter(F.col("s") == "a"), 5).count() == 0


def test_of_a_day_the_last_row_counts(spark):
    rows = [("2024-01-01", 5, 1.0), ("2024-01-01", 9, 2.0), ("2024-01-02", 3, 7.0), ("2024-01-02", 3, 4.0)]
    df = spark.createDataFrame(rows, "day string, at int, x double")
    assert sorted(tuple(r) for r in feat.last_of_day(df.repartition(3), "at").collect()) == [("2024-01-01", 2.0), ("2024-01-02", 7.0)]


def test_trees_with_columns_of_their_own_learn_and_repeat(spark):
    rng = random.Random(3)
    program = feat.NEXT_BANK_DAY
    rows = []
    for i in range(400):
        x = [rng.uniform(-1, 1) for _ in feat.FEATURES]
        rows.append((date(2020, 1, 1) + timedelta(i), 3 * x[0] + 2 * (x[4] > 0) + rng.gauss(0, 0.1), *x))
    schema = f"day date, {program.label} double, " + ", ".join(f"{c} double" for c in feat.FEATURES)
    df = spark.createDataFrame(rows, schema)
    known, unseen = df.filter("day < DATE '2020-10-01'"), df.filter("day >= DATE '2020-10-01'")
    model, losses = feat.train_by_tree(known, program, rounds=12, depth=3, rate=0.3)
    again, same = feat.train_by_tree(known.repartition(3), program, rounds=12, depth=3, rate=0.3)
    assert losses == pytest.approx(same) and model.columns == again.columns
    assert losses[-1] < 0.3 * losses[0] and len({tuple(c) for c in model.columns}) > 1 and all(len(c) == 8 for c in model.columns)
    got = [(r["prediction"], r[program.label]) for r in model.predicted(unseen).collect()]
    mean = sum(y for _, y in got) / len(got)
    assert sum((p - y) ** 2 for p, y in got) < 0.4 * sum((y - mean) ** 2 for _, y in got)
    assert model.predicted(unseen).columns == [*unseen.columns, "prediction"]
    with pytest.raises(ValueError):
        feat.train_by_tree(known.limit(0), program, rounds=1)
