"""Scalar expressions: money, rates, signs, epochs.

Spark 4 raises on division by zero, so every divisor goes through
``try_divide``: a zero divisor gives NULL where the dashboards would chart an
infinite or undefined point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- money -----------------------------------------------------------------


def money_from_number(value: Column | str, currency: str = "USD") -> Column:
    """Split a number into whole units and billionths: ``(units, nanos, currency)``."""
    value = _c(value).cast("double")
    units = value.cast("long")
    nanos = F.round((value - units) * F.lit(float(NANOS)), 0).cast("int")
    return F.struct(units.alias("units"), nanos.alias("nanos"), F.lit(currency).alias("currency"))


def money_is_valid(units: Column | str, nanos: Column | str) -> Column:
    """Units and nanos may not point in opposite directions."""
    return F.signum(_c(units).cast("double")) * F.signum(_c(nanos).cast("double")) >= 0


def money_amount(units: Column | str, nanos: Column | str) -> Column:
    """``units + nanos / 1e9`` as DECIMAL(38,9); NULL for mixed signs."""
    whole = _c(units).cast("decimal(28,0)")
    part = (_c(nanos).cast("decimal(10,0)") * F.lit("0.000000001").cast("decimal(9,9)"))
    return F.when(money_is_valid(units, nanos), (whole + part).cast("decimal(38,9)"))


def timestamp_is_valid(seconds: Column | str, nanos: Column | str) -> Column:
    return (_c(seconds) >= 0) & _c(nanos).between(0, NANOS - 1)


# --- rates -----------------------------------------------------------------


def pct_change(current: Column | str, base: Column | str) -> Column:
    """``(current - base) / base * 100``."""
    return F.try_divide(_c(current) - _c(base), _c(base)) * 100.0


def symmetric_rate(a: Column | str, b: Column | str) -> Column:
    """``(a - b) / (a + b) * 100``."""
    return F.try_divide(_c(a) - _c(b), _c(a) + _c(b)) * 100.0


def attribution(index: Column | str, member: Column | str, relevance: float) -> Column:
    """How much a member's move explains the index move; larger relevance favours big index days."""
    return F.try_divide(_c(member) * _c(index), F.pow(_c(index), 2.0) + F.lit(float(relevance)))


def annualised_rate(value: Column | str, ts: Column | str, base_date: str) -> Column:
    """Yearly growth in percent that turns 1.0 at ``base_date`` into ``value`` at ``ts``."""
    days = F.floor((F.unix_seconds(_c(ts)) - F.unix_seconds(F.lit(base_date).cast("timestamp"))) / 86400)
    years = days / F.lit(365.0)
    return (F.pow(_c(value), F.try_divide(F.lit(1.0), years)) - 1.0) * 100.0


def signed_value(value: Column | str, current: Column | str, previous: Column | str) -> Column:
    """Positive on a rise (hoarding), negative otherwise (dumping)."""
    return F.when(_c(current) > _c(previous), _c(value)).otherwise(-_c(value))


def spread_emphasis(x: Column | str) -> Column:
    """Push values away from zero while keeping their order."""
    return F.lit(10000.0) * F.tanh(_c(x) * 0.3)


#: Rates closer to zero than this have no direction: what is left where prices cancel.
NO_DIRECTION = 1e-9


def sign(x: Column | str) -> Column:
    return F.when(_c(x) > NO_DIRECTION, 1).when(_c(x) < -NO_DIRECTION, -1).otherwise(0)


def positive_log(x: Column | str) -> Column:
    """Natural log, NULL for values that have none."""
    return F.when(_c(x) > 0, F.ln(_c(x)))


def non_zero(x: Column | str) -> Column:
    """NULL in place of zero: zero means "no observation" in window results."""
    return F.nullif(_c(x), F.lit(0.0))


# --- sets and lists --------------------------------------------------------


def in_scope(column: Column | str, included: list[str] | None = None, excluded: list[str] | None = None) -> Column:
    """Include list applies when it is not empty, exclude list likewise."""
    keep = F.lit(True)
    if included:
        keep = keep & _c(column).isin(list(included))
    wanted_out = [x for x in (excluded or []) if x]
    if wanted_out:
        keep = keep & ~_c(column).isin(wanted_out)
    return keep


def split_tickers(text: Column | str) -> Column:
    """``"AAPL, MSFT ,"`` → ``["AAPL", "MSFT"]``."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda t: F.trim(t)), lambda t: t != "")


def rename_by(mapping: dict[str, str], field: Column | str) -> Column:
    """Dictionary lookup that falls back to the key itself."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, _c(field)), _c(field))


def shared_keys(a: Column | str, b: Column | str) -> Column:
    """Entries of map ``b`` whose key also occurs in map ``a``."""
    return F.map_filter(_c(b), lambda k, _: F.map_contains_key(_c(a), k))


def string_tag(json: Column | str, key: str) -> Column:
    """One value of a flat JSON object of strings."""
    return F.get_json_object(_c(json), f"$.{key}")


# --- time ------------------------------------------------------------------


def epoch_to_millis(epoch: Column | str) -> Column:
    """Bring an epoch in ns, us, ms or s to milliseconds, judged by its magnitude."""
    e = _c(epoch).cast("double")
    return (
        F.when(e >= 1e18, e / 1e6).when(e >= 1e15, e / 1e3).when(e >= 1e12, e).when(e >= 1e9, e * 1e3).otherwise(e)
    )


def epoch_nanos(ts: Column | str) -> Column:
    """Whole seconds of a timestamp as nanoseconds, the resolution of stored points."""
    return F.unix_seconds(_c(ts).cast("timestamp")) * F.lit(NANOS)


def measure_id(measurement: str, ticker: Column | str, ts: Column | str) -> Column:
    """Id derived from the key, so that a retry writes the same row again."""
    return F.sha2(
        F.concat_ws("|", F.lit(measurement), _c(ticker), F.unix_seconds(_c(ts)).cast("string")), 256
    )


def whole_days(begins: Column | str, ends: Column | str) -> Column:
    return F.floor((F.unix_micros(_c(ends)) - F.unix_micros(_c(begins))) / F.lit(86_400_000_000))
