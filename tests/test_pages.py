import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickwise.functions import chart
from tickwise.sources import bars as bar_source
from tickwise.sources import pages

T0 = datetime(2024, 3, 1, 14, 30)
BARS = "ticker string, n long, market_ts timestamp, opening_price double, closing_price double, high_price double, low_price double, volume_weighted_avg_price double, volume long"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    rows = [(t, i, T0 + timedelta(days=i % 90, minutes=30 * (i % 4)), 1.0 + i, 2.0, 3.0, None if i == 7 else 0.5, 1.5, 10 * i) for t, n in (("A", 230), ("B.C", 5), ("D E", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, BARS)
    path = str(tmp_path_factory.mktemp("pages"))
    pages.land_pages(df, path, ["market_ts", "n"], 20)
    return df, path


def test_pages_are_written_by_tasks_under_any_ticker(spark, tmp_path):
    rows = [(t, i, T0 + timedelta(minutes=i), 1.0, 2.0, 3.0, 0.5, 1.5, i) for t in ("A/B:C", "A B%") for i in range(45)]
    path = str(tmp_path / "pages")
    for _ in range(2):  # a second run puts the same pages beside the first's
        pages.land_pages(spark.createDataFrame(rows, BARS), path, ["market_ts", "n"], 20)
    files = [p for p in Path(path).rglob("*") if p.is_file()]
    # no trace of a commit that moves folders in the driver
    assert len(files) == 12 and all(p.name.startswith("part-") and p.parent.name.startswith("page=") for p in files)
    got = pages.read_bars(spark, path, starts(spark, **{"A/B:C": T0, "A B%": T0}))
    assert sorted((r.ticker, r.volume) for r in got.collect()) == sorted((r[0], r[-1]) for r in rows)


def test_pages_that_follow_each_other_share_a_file(spark, tmp_path):
    at = lambda i: T0 + timedelta(days=i % 75, minutes=30 * (i % 3))
    rows = [(t, i, at(i), 1.0 + i / 7, 2.0, 3.0, None if i % 5 else 0.5, 1.5, i) for t, n in (("A/B:C", 2_000), ("D", 7), ("E", 50)) for i in range(n)]
    rows += rows[:30]  # rows that are equal stay rows
    df = spark.createDataFrame(rows, BARS)
    ways = {together: str(tmp_path / f"by-{together}") for together in (1, 8)}
    for together, path in ways.items():
        pages.land_pages(df, path, ["market_ts", "n"], 10, together=together)
    files = {k: [p for p in Path(v).rglob("*") if p.is_file()] for k, v in ways.items()}
    assert len(files[1]) == 203 + 1 + 5 and len(files[8]) < 60
    disk = {k: sum(p.stat().st_blocks * 512 for p in Path(v).rglob("*")) for k, v in ways.items()}
    assert disk[8] < 0.3 * disk[1]
    # page after page as with a file each
    chains = {}
    for together, path in ways.items():
        chain, folder = [], Path(path) / "ticker=A%2FB%3AC"
        token = min(p.name for p in folder.iterdir()).removeprefix("page=")
        reader = pages.PageReader(path, {}, 0)
        system, root = pages.file_system(str(folder))
        while token:
            for page in reader._pages(system, f"{root}/page={token}"):
                chain.append((token, page))
                token = page["next_page_token"]
        chains[together] = chain
    assert chains[1] == chains[8] and [len(p["bars"]["A/B:C"]) for _, p in chains[8]] == [10] * 203
    since = {"A/B:C": T0 + timedelta(days=33, minutes=1), "D": T0 + timedelta(days=2), "E": T0 + timedelta(days=400), "NONE": T0}
    got = pages.read_bars(spark, ways[8], starts(spark, **since))
    want = df.select(*got.columns).filter(F.col("market_ts") >= F.create_map(*[x for k, v in since.items() for x in (F.lit(k), F.lit(v))])[F.col("ticker")])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.count() > 500


def test_landed_bars_take_little_disk(spark, tmp_path):
    """As ``paged_bars`` and ``tickers_without_pages`` land them: neither pages nor what moves before them outgrow the table."""
    from tickwise.plans import registry

    n = 60_000
    row = spark.range(n).withColumn("r", F.rand(7))
    lineitem = row.select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") % 999).alias("l_partkey"), (F.col("id") % 40).alias("l_suppkey"),
        (1.0 + F.col("id") % 50).alias("l_quantity"), F.round(1000 + F.col("r") * 90_000, 2).alias("l_extendedprice"), (F.col("id") % 11 / 100).alias("l_discount"),
        F.timestamp_seconds(F.lit(852_076_800) + (F.col("r") * 700).cast("int") * 86_400).alias("l_shipdate"),
    )
    supplier = spark.range(40).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).cast("int").alias("s_nationkey"))
    nation = spark.range(3).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"))
    for name, df in (("lineitem", lineitem), ("supplier", supplier), ("nation", nation)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    path, since = registry._landed(spark, str(tmp_path))
    landed = sum(p.stat().st_blocks * 512 for p in Path(path.removeprefix("file:")).rglob("*"))
    assert landed < 60 * n  # 205 bytes a bar where each page had a folder
    assert pages.read_bars(spark, path, since).filter("ticker = 'N1'").count() == n // 2
    assert {r.ticker for r in registry.tickers_without_pages(spark, str(tmp_path)).collect()} == {"N2", "GONE"}


@pytest.mark.parametrize("count", [3, 5_000])
def test_packed_rows_arrive_whole_and_by_key(spark, monkeypatch, count):
    monkeypatch.setattr(pages, "PACKED_ROWS", 700)
    df = spark.range(count, numPartitions=3).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 9)).alias("k"), "id", F.struct((F.col("id") % 5).alias("a"), F.lit("x").alias("b")).alias("s"),
        F.timestamp_seconds("id").alias("t"), F.lit(None).cast("double").alias("z"),
    )
    dealt = pages.dealt_out(df, ["k"])
    assert dealt.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    assert dealt.select("k", F.spark_partition_id().alias("p")).distinct().groupBy("k").count().filter("count > 1").count() == 0


def starts(spark, **since):
    return spark.createDataFrame([(t, s) for t, s in since.items()], "ticker string, start timestamp")


def test_pages_hold_their_bars_and_the_next_token(spark, landed):
    df, path = landed
    folder = Path(path) / "ticker=A"
    names = sorted(p.name for p in folder.iterdir())
    assert len(names) == 12
    read = lambda name: json.loads(next((folder / name).glob("part-*")).read_text())
    seen, token = [], names[0].removeprefix("page=")
    while token:
        page = read(f"page={token}")
        seen.append(len(page["bars"]["A"]))
        token = page["next_page_token"]
    assert seen == [20] * 11 + [10]
    decoded = bar_source.bars_from_pages(bar_source.read_pages(spark, path))
    assert decoded.count() == df.count()


def test_each_ticker_is_read_from_its_start(spark, landed):
    df, path = landed
    since = {"A": T0 + timedelta(days=40), "B.C": T0, "NONE": T0}
    got = pages.read_bars(spark, path, starts(spark, **since))
    columns = got.columns
    want = df.select(*columns).filter((F.col("ticker") == "A") & (F.col("market_ts") >= since["A"]) | (F.col("ticker") == "B.C"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.count() > 50
    assert got.filter("low_price IS NULL").count() == want.filter("low_price IS NULL").count()


def test_conditions_choose_partitions_and_pages(spark, landed):
    df, path = landed
    got = pages.read_bars(spark, path, starts(spark, A=T0, **{"B.C": T0}), pushdown=True).filter((F.col("ticker") == "A") & (F.col("market_ts") >= T0 + timedelta(days=88)))
    assert got.rdd.getNumPartitions() == 1
    assert got.count() == df.filter((F.col("ticker") == "A") & (F.col("market_ts") >= T0 + timedelta(days=88))).count() > 0
    reader = pages.FilteringPageReader(path, {"A": 5, "B.C": 7}, -100)
    wanted = [pages.In(("ticker",), ("A", "X")), pages.GreaterThan(("market_ts",), datetime(1970, 1, 1, 0, 0, 1))]
    assert list(reader.pushFilters(wanted)) == wanted
    assert [(p.ticker, p.start) for p in reader.partitions()] == [("A", 1_000_000)]


def test_nearest_point_before_or_after(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    points = spark.createDataFrame([("x", at(0), 1), ("x", at(10), 2), ("x", at(10), 2), ("y", at(5), 3), (None, at(1), 4)], "k string, ts timestamp, v int")
    asked = spark.createDataFrame([("x", at(-3), 0), ("x", at(4), 1), ("x", at(5), 2), ("x", at(6), 3), ("x", at(10), 4), ("x", at(50), 5), ("y", at(5), 6), ("z", at(5), 7), (None, at(2), 8)], "k string, ts timestamp, n int")
    found = {r.n: (r.v, r.distance) for r in chart.nearest_points(points, asked, ["k"], "ts", ["v"]).collect()}
    assert found == {0: (1, 3.0), 1: (1, 4.0), 2: (1, 5.0), 3: (2, 4.0), 4: (2, 0.0), 5: (2, 40.0), 6: (3, 0.0), 7: (None, None), 8: (4, 1.0)}
    near = {r.n: r.v for r in chart.nearest_points(points, asked, ["k"], "ts", ["v"], within=5.0).collect()}
    assert near[5] is None and near[2] == 1 and near[0] == 1
    assert "Join" not in chart.nearest_points(points, asked, ["k"], "ts", ["v"])._jdf.queryExecution().executedPlan().toString()


def test_nearest_points_lie_slices_away_and_no_frame_runs_to_the_end(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    times = [0, 10, 3 * 3600 + 5, 40 * 3600, 40 * 3600 + 7199]
    points = spark.createDataFrame([(k, at(s + d), s) for k, d in (("x", 0), (None, 900)) for s in times], "k string, ts timestamp, v int")
    wanted = [-90_000, -1, 9, 3600, 7000, 12_000, 80_000, 100_000, 140_000, 147_600, 147_601, 190_000]
    asked = spark.createDataFrame([(k, at(s), s) for k in ("x", None) for s in wanted] + [("x", None, 1)], "k string, ts timestamp, n int")
    found = chart.nearest_points(points, asked, ["k"], "ts", ["v"])
    got = {(r.k, r.n): (r.v, r.distance) for r in found.filter("ts IS NOT NULL").collect()}
    best = lambda d, n: min((abs(s + d - n), s) for s in times)
    assert got == {(k, n): (best(d, n)[1], float(best(d, n)[0])) for k, d in (("x", 0), (None, 900)) for n in wanted}
    assert found.count() == asked.count()
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_lines_follow_x_in_pieces(spark):
    rows = [("a", float(x), float(-x)) for x in (5, 1, 3, 2, 4)] + [("a", None, 1.0), ("a", float("nan"), 1.0), ("b", 1.0, 2.5)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {(r.k, r.piece): r.line for r in chart.polylines(df, ["k"], piece=3, digits=1).collect()}
    assert got == {("a", 0): "1.0,-1.0 2.0,-2.0 3.0,-3.0", ("a", 1): "4.0,-4.0 5.0,-5.0", ("b", 0): "1.0,2.5"}
