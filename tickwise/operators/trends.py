"""Trend segmentation of ordered series by linear regression.

Segmentation is sequential inside a series (each cut decides where the next window
starts), so one series, with one row per day, is one task; series run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SERIES = ("measurement", "ticker")
DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class TrendRules:
    """Smallest window, slope change that cuts, and cut-point tolerance."""

    minimum_window: int = 7
    slope_threshold: float = 0.8
    tolerance: float = 0.05


def regression(values: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and mean squared residual of the percent change over 0..n-1."""
    y = (values / values[0] - 1.0) * 100.0
    x = np.arange(len(y)) - (len(y) - 1) / 2
    slope = float(x @ y / (x @ x))
    residual = y - y.mean() - slope * x
    return slope, float(y.mean() - slope * (len(y) - 1) / 2), float(residual @ residual / len(y))


class _Slopes:
    """Slopes of the percent change over any rows begin..end-1 of a series, from running sums."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.sums = np.concatenate(([0.0], np.cumsum(values)))
        self.moments = np.concatenate(([0.0], np.cumsum(values * np.arange(len(values)))))

    def slope(self, begin: int, end: int) -> float:
        n = end - begin
        moment = self.moments[end] - self.moments[begin] - (begin + end - 1) / 2 * (self.sums[end] - self.sums[begin])
        return 100.0 / self.values[begin] * moment * 12.0 / (n * (n * n - 1.0))


def find_segments(values: np.ndarray, rules: TrendRules = TrendRules()) -> tuple[list[tuple], int]:
    """Confirmed segments of one series and the row where the undecided tail begins.

    A window grows row by row from ``begin``; once the slope of its last rows departs
    from its own, the segment ends at the last tail row close to the matching row at
    the window's head, and the next window begins there. Slopes come from running sums, so a
    row costs the same however long its window is.
    """
    m = rules.minimum_window
    n, begin, end = len(values), 0, 2 * m
    slopes = _Slopes(values)
    segments = []
    while n - end >= 2 * m:
        end += 1
        if end - begin < 2 * m:
            continue
        if abs(slopes.slope(begin, end) - slopes.slope(end - m, end)) <= rules.slope_threshold:
            continue
        tail = values[end - m : end]
        close = np.flatnonzero(np.abs(tail - values[begin : begin + m]) <= rules.tolerance)
        cut = int(close[-1]) if len(close) else 0
        segments.append((begin, end - m + cut, *regression(values[begin:end])))
        begin, end = end - m + cut, end + cut
    return segments, begin


SEGMENT_FIELDS = (
    "begins timestamp, ends timestamp, growth double, "
    "regression_slope double, regression_intercept double, regression_variance double"
)


def segment_rows(times: pd.Series, segments: list[tuple]) -> pd.DataFrame:
    """Segments as rows; growth is the slope times the whole days covered."""
    begins = times.iloc[[s[0] for s in segments]].reset_index(drop=True)
    ends = times.iloc[[s[1] for s in segments]].reset_index(drop=True)
    fit = pd.DataFrame([s[2:] for s in segments], columns=["slope", "intercept", "variance"], dtype=float)
    return pd.DataFrame(
        {
            "begins": begins,
            "ends": ends,
            "growth": fit["slope"] * (ends - begins).dt.days,
            "regression_slope": fit["slope"],
            "regression_intercept": fit["intercept"],
            "regression_variance": fit["variance"],
        }
    )


def trend_segments(df: DataFrame, value: str = "price_change_avg", keys: Sequence[str] = SERIES, ts: str = "ts", rules: TrendRules = TrendRules()) -> DataFrame:
    """Confirmed segments per series, labelled with their end."""
    distinct = df.groupBy(*keys, ts).agg(F.min(value).alias(value))

    def per_series(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ts, ignore_index=True)
        segments, _ = find_segments(rows[value].to_numpy(dtype=float), rules)
        out = segment_rows(rows[ts], segments)
        for name, part in zip(keys, key):
            out[name] = part
        return out[[*keys, *[f.split()[0] for f in SEGMENT_FIELDS.split(", ")]]]

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + SEGMENT_FIELDS
    found = distinct.groupBy(*keys).applyInPandas(per_series, schema)
    return found.withColumn("ts", F.col("ends"))


def undecided_tail(df: DataFrame, value: str = "price_change_avg", keys: Sequence[str] = SERIES, ts: str = "ts", rules: TrendRules = TrendRules()) -> DataFrame:
    """Rows of each series that no confirmed segment covers yet."""
    distinct = df.groupBy(*keys, ts).agg(F.min(value).alias(value))

    def per_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ts, ignore_index=True)
        _, begin = find_segments(rows[value].to_numpy(dtype=float), rules)
        return rows.iloc[begin:]

    return distinct.groupBy(*keys).applyInPandas(per_series, distinct.schema)


def linear_regression(df: DataFrame, value: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Slope, intercept and variance of the percent change since the first row of each series."""
    by = Window.partitionBy(*keys).orderBy(ts)
    points = df.select(
        *keys,
        ((F.try_divide(F.col(value), F.first(value).over(by)) - 1) * 100).alias("y"),
        (F.row_number().over(by) - 1).cast("double").alias("x"),
    )
    fitted = points.groupBy(*keys).agg(
        F.count("y").alias("points"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_syy("y", "x").alias("_syy"),
        F.regr_sxx("y", "x").alias("_sxx"),
    )
    variance = (F.col("_syy") - F.pow("slope", F.lit(2.0)) * F.col("_sxx")) / F.col("points")
    return fitted.select(*keys, "points", "slope", "intercept", variance.alias("variance"))


def largest_deviation(tail: DataFrame, overall: DataFrame, value: str, keys: list[str], alpha: float = 0.2, position: str = "position") -> DataFrame:
    """Tail row that departs most from the overall series at the same position.

    ``alpha`` 0 uses the plain distance, 1 weighs by closeness to the tail's centre.
    """
    sizes = tail.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / 2).alias("_centre"))
    paired = tail.join(overall.select(*keys, position, F.col(value).alias("_overall")), [*keys, position]).join(sizes, keys)
    plain = F.abs(F.col(value) - F.col("_overall"))
    centred = plain / (1 + F.abs(F.col(position) - F.col("_centre")))
    scored = paired.withColumn("residual", F.lit(alpha) * centred + F.lit(1 - alpha) * plain)
    best = F.max_by(F.struct(position, value, "residual"), F.struct(F.col("residual"), -F.col(position)))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
