"""Daily feature tables, their export, model training and batch prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalar import epoch_nanos, pct_change, positive_log
from tickwise.operators.bars import top_tickers
from tickwise.operators.drawdown import drawdown_labels
from tickwise.operators.quality import check_columns, hold_out_tail
from tickwise.operators.series import kaufman_average, moving_average
from tickwise.session import fresh_path
from tickwise.sources import store

KEYS = ["measurement", "ticker"]

# First usable day and look-aheads in bank days.
ANALYSIS_START = "2016-06-01"
TWO_WEEKS, FIVE_WEEKS, TWO_MONTHS, FOUR_MONTHS = 10, 25, 42, 85
TOP_TICKERS, TOP_DAYS = 50, 15

# Feature columns in export order (the label goes first).
FEATURES = [
    "members_daily_spread",
    "index_over_moving_avg",
    "index_over_kaufman_avg",
    "volume_over_moving_avg",
    "current_drawdown",
    "days_since_dip_of_3",
    "days_since_dip_of_5",
    "days_since_dip_of_8",
    "days_since_dip_of_13",
    "vix",
]


@dataclass(frozen=True)
class Program:
    """One feature table: its label, look-ahead and averaging lengths."""

    name: str
    label: str
    variant: str
    forward_days: int
    index_days: int
    volume_days: int

    @property
    def columns(self) -> list[str]:
        return [self.label, *FEATURES]

    @property
    def training_measurement(self) -> str:
        return f"{self.label.replace('_', '-')}-training-data-{self.variant}"

    @property
    def result_measurement(self) -> str:
        base = f"{self.label.replace('_', '-')}-prediction-results"
        return f"{base}-{self.variant}" if self.variant else base


NEXT_BANK_DAY = Program("drawdown-next-bank-day", "drawdown_next_bank_day", "", 0, TWO_MONTHS, TWO_MONTHS)
FORWARD_TWO_WEEKS = Program(
    "forward-max-drawdown-two-weeks", "forward_max_drawdown", "two-weeks", TWO_WEEKS, TWO_MONTHS, TWO_MONTHS
)
FORWARD_FIVE_WEEKS = Program(
    "forward-max-drawdown-five-weeks", "forward_max_drawdown", "five-weeks", FIVE_WEEKS, FOUR_MONTHS, FOUR_MONTHS
)
PROGRAMS = [NEXT_BANK_DAY, FORWARD_TWO_WEEKS, FORWARD_FIVE_WEEKS]


def since(df: DataFrame, start: str, day: str = "day") -> DataFrame:
    return df.filter(F.col(day) >= F.lit(start).cast("date"))


def last_of_day(rows: DataFrame, at: str) -> DataFrame:
    """One row a day: that of the latest ``at``, the largest by its values where several have it."""
    names = [c for c in rows.columns if c not in ("day", at)]
    return rows.groupBy("day").agg(F.max_by(F.struct(*names), F.struct(at, *names)).alias("_row")).select("day", "_row.*")


def drawdown_features(levels: DataFrame, forward_days: int, start: str = ANALYSIS_START) -> DataFrame:
    rows = since(levels.withColumn("day", F.to_date("ts")), start).filter(F.col("drawdown_low").isNotNull())
    return drawdown_labels(rows, forward_days).drop(*KEYS).withColumn("day", F.to_date("ts"))


def index_features(index: DataFrame, n: int, start: str = ANALYSIS_START) -> DataFrame:
    """Log of the index high over its moving and its Kaufman average."""
    logs = since(index, start).select(*KEYS, "ts", positive_log("price_change_high").alias("value"))
    average = moving_average(logs, "value", n, KEYS)
    adaptive = kaufman_average(logs, "value", n, KEYS).drop("value")
    return average.join(adaptive, [*KEYS, "ts"]).select(
        "ts",
        F.to_date("ts").alias("day"),
        (F.col("value") - F.col("moving_average")).alias("index_over_moving_avg"),
        (F.col("value") - F.col("kaufman_average")).alias("index_over_kaufman_avg"),
    )


def volume_features(index: DataFrame, n: int, start: str = ANALYSIS_START) -> DataFrame:
    """Traded value over its moving average; value and average lie in one row, so no join."""
    rows = since(index, start).select(*KEYS, "ts", "total_trading_value")
    average = moving_average(rows, "total_trading_value", n, KEYS)
    return average.select("ts", F.to_date("ts").alias("day"), (F.col("total_trading_value") - F.col("moving_average")).alias("volume_over_moving_avg"))


def member_spread(members: DataFrame, start: str = ANALYSIS_START, n: int = TOP_TICKERS, days: int = TOP_DAYS, as_of: Column | None = None) -> DataFrame:
    """How far the daily changes of the most traded members lie apart.

    Mean of the spreads of the middle 50 % and 80 %.  The member list holds ``n`` rows.
    """
    top = top_tickers(members, n, days, as_of).select("ticker")
    changes = since(members, start).join(top, "ticker", "left_semi")
    q = F.percentile(pct_change("price_change_avg", "prev_price_change_avg"), F.array(*[F.lit(x) for x in (0.10, 0.25, 0.75, 0.90)]))
    return changes.groupBy("day").agg(q.alias("q")).select(
        "day", ((F.col("q")[2] - F.col("q")[1] + F.col("q")[3] - F.col("q")[0]) / 2).alias("members_daily_spread")
    )


def daily_features(
    program: Program,
    levels: DataFrame,
    index: DataFrame,
    extended_members: DataFrame,
    volatility: DataFrame,
    start: str = ANALYSIS_START,
    as_of: Column | None = None,
    top: int = TOP_TICKERS,
) -> DataFrame:
    """One row per day on which all five inputs have one; of a day that an input has twice, its last row counts.

    Volatility rows are told apart by their ``ts`` where they have one.
    """
    vix = since(volatility, start)
    vix = vix.select("day", (F.col("ts") if "ts" in vix.columns else F.col("day")).alias("ts"), F.col("value").alias("vix"))
    joined = last_of_day(drawdown_features(levels, program.forward_days, start), "ts")
    for part in (
        last_of_day(index_features(index, program.index_days, start), "ts"),
        member_spread(extended_members, start, top, as_of=as_of),
        last_of_day(vix, "ts"),
        last_of_day(volume_features(index, program.volume_days, start), "ts"),
    ):
        joined = joined.join(part, "day")
    return joined.select("day", *program.columns)


def export_csv(features: DataFrame, program: Program, folder: str, run_id: str, hold_out: int = 375) -> None:
    """Header-less gzip CSV, label first, without the last days; also as ``latest``."""
    rows = hold_out_tail(features, hold_out).drop("day")
    target = f"{folder}/{program.name}/{run_id}"
    writer = check_columns(rows, program.columns, program.label).write.mode("overwrite")
    writer.option("compression", "gzip").csv(target, header=False)
    spark = features.sparkSession
    spark.read.text(target).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{program.name}/latest")


def feature_lines(features: DataFrame, program: Program) -> DataFrame:
    """Feature rows as text points; whole numbers carry ``i``."""
    kinds = dict(features.dtypes)

    def text(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.concat(F.lit(f"{name}="), value, F.lit("i" if kinds[name] in ("int", "bigint") else ""))

    body = F.concat_ws(",", *[text(c) for c in program.columns])
    return features.select(
        F.concat_ws(" ", F.lit(program.training_measurement), body, epoch_nanos("day").cast("string")).alias("value")
    )


def train(features: DataFrame, program: Program, rounds: int = 200, depth: int = 5, rate: float = 0.1, seed: int = 0):
    """Boosted regression trees: 200 rounds, depth 5, rate 0.1, 80 % of rows and columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trees = GBTRegressor(
        featuresCol="features", labelCol=program.label, predictionCol="prediction", maxIter=rounds, maxDepth=depth,
        stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", lossType="squared", seed=seed,
        checkpointInterval=10,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(features)


@dataclass(frozen=True)
class BoostedTrees:
    """A base value and the trees that step towards the label, each with the columns it was drawn."""

    base: float
    rate: float
    trees: list
    columns: list[list[str]]

    def predicted(self, rows: DataFrame, into: str = "prediction") -> DataFrame:
        """``rows`` with the sum of all trees; each tree reads its own columns as one vector."""
        total = F.lit(self.base)
        for i, (tree, names) in enumerate(zip(self.trees, self.columns)):
            rows = _with_vector(rows, names, "_v")
            rows = tree.setFeaturesCol("_v").setPredictionCol(f"_p{i}").transform(rows).drop("_v")
            total = total + F.lit(self.rate) * F.col(f"_p{i}")
        return rows.withColumn(into, total).drop(*[f"_p{i}" for i in range(len(self.trees))])


def _with_vector(rows: DataFrame, names: list[str], into: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol=into).transform(rows)


#: Trees between two tables that cut the lineage of the residuals.
STORE_EVERY = 10


def train_by_tree(features: DataFrame, program: Program, rounds: int = 200, depth: int = 5, rate: float = 0.1, share: float = 0.8, seed: int = 0) -> tuple[BoostedTrees, list[float]]:
    """Boosted regression trees whose rows and columns are drawn once a tree; the model and the loss after each round.

    Each tree is fitted to what the trees before leave of the label. A row is drawn by a hash of its day and the round and
    columns by a generator of the seed, so that a training run can be repeated whatever the partitioning. The loss is the mean square over all rows.
    """
    import random

    from pyspark.ml.regression import DecisionTreeRegressor

    spark = features.sparkSession
    draw = random.Random(seed)
    rows = store.staged(features.select("day", *FEATURES, F.col(program.label).cast("double").alias("_label")), fresh_path(spark, "boosting"))
    base = rows.agg(F.avg("_label")).first()[0]
    if base is None:
        raise ValueError("no rows to train on")
    rows = rows.withColumn("_left", F.col("_label") - F.lit(base))
    trees, columns, losses = [], [], []
    wanted = max(1, round(share * len(FEATURES)))
    for i in range(rounds):
        names = sorted(draw.sample(FEATURES, wanted), key=FEATURES.index)
        drawn = F.pmod(F.xxhash64(F.col("day").cast("string"), F.lit(seed), F.lit(i)), F.lit(1000)) < round(1000 * share)
        tree = DecisionTreeRegressor(featuresCol="_v", labelCol="_left", predictionCol="_p", maxDepth=depth, seed=seed + i)
        vectors = _with_vector(rows, names, "_v")
        model = tree.fit(vectors.filter(drawn))
        rows = model.transform(vectors).withColumn("_left", F.col("_left") - F.lit(rate) * F.col("_p")).drop("_v", "_p")
        if (i + 1) % STORE_EVERY == 0:
            rows = store.staged(rows, fresh_path(spark, "boosting"))
        losses.append(rows.agg(F.avg(F.col("_left") * F.col("_left"))).first()[0])
        trees.append(model)
        columns.append(names)
    return BoostedTrees(base, rate, trees, columns), losses


def save_model(model, folder: str, program: Program, model_id: str) -> None:
    for name in (model_id, "latest"):
        model.write().overwrite().save(f"{folder}/{program.name}/{name}")


def load_model(folder: str, program: Program, model_id: str | None = None):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{folder}/{program.name}/{model_id or 'latest'}")


def predict(features: DataFrame, model, program: Program) -> DataFrame:
    """Predicted label per day."""
    return model.transform(features).select(
        F.lit(program.result_measurement).alias("measurement"), "day", F.col("prediction").alias(program.label)
    )
