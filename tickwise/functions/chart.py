"""Chart scaling of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickwise.functions.scalar import _c
from tickwise.operators.series import numbered

#: Seconds of the slices in which nearest points are looked up.
SLICE = 3600


def min_max(x: Column | str, low: Column | str, high: Column | str, multiple: float) -> Column:
    return F.try_divide(_c(x) - _c(low), _c(high) - _c(low)) * multiple


def scale_to(x: Column, source: tuple[Column, Column], target: tuple[float, float]) -> Column:
    """Linear map that puts the source maximum at the target minimum (screen y grows downwards)."""
    a, b = source
    c, d = target
    return F.lit(float(c)) + F.try_divide((x - b) * (d - c), a - b)


def magnitude(span: Column | str) -> Column:
    """Axis unit and postfix by the size of the range."""
    span = _c(span)
    unit = F.when(span > 1e9, 1e9).when(span > 1e6, 1e6).when(span > 1e3, 1e3).otherwise(1.0)
    postfix = F.when(span > 1e9, " b").when(span > 1e6, " m").when(span > 1e3, " k").otherwise("")
    return F.struct(unit.alias("unit"), postfix.alias("postfix"))


def chart_points(
    df: DataFrame,
    value: str,
    price: str,
    ts: str,
    keys: list[str],
    width: float = 1000.0,
    height: float = 400.0,
    offsets: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0),
) -> DataFrame:
    """Positive rows of each chart (one per key) placed on a one-day x axis.

    ``offsets`` is (top, bottom, left, right).  The value range is aggregated per
    chart and joined back, so no chart is gathered into one task.
    """
    top, bottom, left, right = offsets
    shown = df.filter((F.col(price) > 0) & (F.col(value) > 0))
    span = shown.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    x = min_max(seconds.cast("double"), F.lit(0.0), F.lit(86399.0), width - left - right) + left
    y = scale_to(F.col(value), (F.col("_low") * 0.98, F.col("_high") * 1.02), (0.0, height - top - bottom)) + top
    return shown.join(span, keys).select(
        *keys, F.col(ts).alias("ts"), x.alias("x"), y.alias("y"), F.col(price).alias("price"), F.col(value).alias("value")
    )


def nearest_points(points: DataFrame, asked: DataFrame, keys: list[str], ts: str, values: list[str], within: float | None = None) -> DataFrame:
    """For each asked time of a chart the point nearest to it, with ``values`` and ``distance`` in seconds.

    Of two points equally near the earlier counts. No point within ``within`` seconds: nulls. Points and asked times are cut into slices of
    ``SLICE`` seconds. The last point before a slice and the first after it join the slice's rows, where two running windows, one from either end, find
    the neighbours: no time meets all points, and no chart is gathered into one task.
    """
    held = F.struct(F.col(ts), *[F.col(v) for v in values])
    slice_ = F.coalesce(F.floor(F.unix_seconds(ts) / SLICE), F.lit(-(1 << 62)))
    row = lambda df, is_point, point, columns: df.select(*keys, slice_.alias("_slice"), F.col(ts).alias("_ts"), F.lit(is_point).alias("_is_point"), point.alias("_point"), columns.alias("_asked"))
    own = [c for c in asked.columns if c not in (*keys, ts)]
    nothing = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in asked.dtypes if c in own]) if own else F.lit(None).cast("boolean")
    point_type = points.select(held.alias("p")).schema["p"].dataType
    own_points = row(points, True, held, nothing)
    rows = own_points.unionByName(row(asked, False, F.lit(None).cast(point_type), F.struct(*own) if own else F.lit(None).cast("boolean")))
    # the ends of each slice, also of slices that are only asked for, and what lies beyond them
    place = own_points.select(*keys, "_slice", "_point")
    place = place.unionByName(asked.select(*keys, slice_.alias("_slice")).distinct().withColumn("_point", F.lit(None).cast(point_type)))
    at = F.when(F.col("_point").isNotNull(), F.struct(F.col(f"_point.{ts}")))
    ends = place.groupBy(*keys, "_slice").agg(F.min_by("_point", at).alias("_low"), F.max_by("_point", at).alias("_high"))
    others = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.array(F.last("_high", ignorenulls=True).over(others("_slice")), F.last("_low", ignorenulls=True).over(others(F.desc("_slice"))))
    carried = ends.select(*keys, "_slice", beyond.alias("_beyond")).select(*keys, "_slice", F.explode(F.array_compact("_beyond")).alias("_point"))
    rows = rows.unionByName(carried.select(*keys, "_slice", F.col(f"_point.{ts}").alias("_ts"), F.lit(True).alias("_is_point"), "_point", nothing.alias("_asked")))
    until = lambda *order: Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("_point", ignorenulls=True).over(until("_ts", F.desc("_is_point")))
    after = F.last("_point", ignorenulls=True).over(until(F.desc("_ts"), "_is_point"))
    both = rows.select(*keys, "_ts", "_is_point", "_asked", before.alias("_before"), after.alias("_after")).filter(~F.col("_is_point"))
    apart = lambda side: F.abs(F.unix_micros(F.col(f"{side}.{ts}")) - F.unix_micros("_ts")) / 1_000_000
    first = F.col("_after").isNull() | (apart("_before") <= apart("_after"))
    distance = F.when(first, apart("_before")).otherwise(apart("_after"))
    near = distance <= within if within is not None else F.lit(True)
    chosen = F.when(near, F.when(first, F.col("_before")).otherwise(F.col("_after")))
    found = both.select(*keys, F.col("_ts").alias(ts), "_asked", chosen.alias("_p"), F.when(near, distance).alias("distance"))
    return found.select(*keys, ts, *[F.col(f"_asked.{c}").alias(c) for c in own], F.col(f"_p.{ts}").alias(f"nearest_{ts}"), *[F.col(f"_p.{v}").alias(v) for v in values], "distance")


def polylines(points: DataFrame, keys: list[str], piece: int = 500, x: str = "x", y: str = "y", digits: int = 3) -> DataFrame:
    """Each chart's line as text, ``x,y`` pairs in order of x, in numbered pieces of at most ``piece`` points.

    Points without x or y are left out. A piece is what one row holds; the pieces of a chart, one after the other, are its line.
    """
    present = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    rows = present.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    placed = numbered(rows, keys, F.floor(F.col("_x")), ["_x", "_y"], "_n")
    number = lambda c: F.format_string(f"%.{digits}f", c)
    pair = F.struct("_n", F.concat(number(F.col("_x")), F.lit(","), number(F.col("_y"))).alias("text"))
    pieces = placed.groupBy(*keys, F.floor(F.col("_n") / piece).alias("piece")).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    return pieces.select(*keys, "piece", F.array_join(F.col("_pairs.text"), " ").alias("line"))
