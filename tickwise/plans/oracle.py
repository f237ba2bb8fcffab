"""SQL counterparts of the registered queries, over the same tables.

Each statement is assembled from named parts (common table expressions); only the
parts a statement refers to, directly or through others, are written out.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from tickwise.operators.financials import AMOUNT_ITEMS, ITEMS
from tickwise.operators.windows import (
    QUOTE_DELTAS,
    QUOTE_METRICS,
    QUOTE_WINDOWS,
    TRADE_DELTAS,
    TRADE_METRICS,
    TRADE_WINDOWS,
)
from tickwise.plans import features as feat
from tickwise.plans.microstructure import AMOUNTS, QUOTE_FIELDS, TRADE_FIELDS, VWAPS
from tickwise.plans.rounding import shown_sql

# What the SQL states on its own, so that a wrong constant of the operators shows.
OUTLIER_WIDTH, DEVIATION_SCALE = "4.0", "1.4826"
DIP_LEVELS = {3: 97, 5: 95, 8: 92, 13: 87}
FIXED_HOLIDAYS = ["01-01", "06-19", "07-04", "11-11", "12-24", "12-25"]
#: Month, DuckDB's day of the week (Sunday 0), days of the month.
FLOATING_HOLIDAYS = [(1, 1, "15 AND 21"), (2, 1, "15 AND 21"), (5, 1, "24 AND 31"), (9, 1, "1 AND 7"), (10, 1, "8 AND 14"), (11, 4, "22 AND 28")]


def good_friday(year: int) -> str:
    """Two days before Easter Sunday, by the Gregorian computus."""
    century, golden = divmod(year, 100)[0], year % 19
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * (year % 100 // 4) - moon - year % 100 % 4) % 7
    late = (golden + 11 * moon + 22 * week) // 451
    month, day = divmod(moon + week - 7 * late + 114, 31)
    return (date(year, month, day + 1) - timedelta(days=2)).isoformat()


PRICES = ["open", "close", "high", "low", "avg"]
CHANGES = [f"price_change_{p}" for p in PRICES] + ["prev_price_change_avg"]


def r(expression: str, alias: str | None = None) -> str:
    return f"{shown_sql(expression)} AS {alias or expression}"


def rs(*names: str) -> str:
    return ", ".join(map(r, names))


def bucket(every: str, ts: str) -> str:
    return f"time_bucket(INTERVAL '{every}', {ts}, TIMESTAMP '1970-01-01')"


def measure(name: str, ts: str) -> str:
    return f"sha256(concat_ws('|', '{name}', ticker, CAST(CAST(epoch({ts}) AS BIGINT) AS VARCHAR)))"


def weekend(day: str) -> str:
    return f"(dayofweek({day}) IN (0, 6))"


def holiday(day: str) -> str:
    fixed = ", ".join(f"'{d}'" for d in FIXED_HOLIDAYS)
    floating = [f"(month({day}) = {m} AND dayofweek({day}) = {weekday} AND day({day}) BETWEEN {days})" for m, weekday, days in FLOATING_HOLIDAYS]
    fridays = ", ".join(f"DATE '{good_friday(y)}'" for y in range(2016, 2027))
    return f"(strftime({day}, '%m-%d') IN ({fixed}) OR {' OR '.join(floating)} OR {day} IN ({fridays}))"


def bank_day(day: str) -> str:
    return f"(NOT {weekend(day)} AND NOT {holiday(day)})"


def seek(day: str, step: int) -> str:
    cases = " ".join(
        f"WHEN {bank_day(f'CAST({day} + {step * n} AS DATE)')} THEN CAST({day} + {step * n} AS DATE)" for n in range(1, 8)
    )
    return f"CASE {cases} ELSE CAST({day} + {step * 8} AS DATE) END"


def local(ts: str) -> str:
    return f"timezone('America/New_York', timezone('UTC', {ts}))"


def utc(wall: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', {wall}))"


def regular(ts: str) -> str:
    clock = f"CAST({local(ts)} AS TIME)"
    return f"({clock} >= TIME '09:30:00' AND {clock} < TIME '16:00:00' AND {bank_day(f'CAST({local(ts)} AS DATE)')})"


def median(column: str) -> str:
    return f"quantile_cont({column}, 0.5)"


def rate(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / nullif(({a}) + ({b}), 0) * 100"


def pct(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / nullif({b}, 0) * 100"


PARTS: dict[str, str] = {}

# --- live windows --------------------------------------------------------------

PARTS["trades"] = """
SELECT event_type AS symbol, event_id AS trade_id, ts AS market_ts, value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS lot_size FROM events"""

PARTS["quotes"] = """
SELECT symbol, market_ts, trade_id, price * 1.01 AS ask, 1.0 + trade_id % 100 AS ask_lot, price * 0.99 AS bid,
       lot_size AS bid_lot FROM trades"""

PARTS["tw0"] = f"""
SELECT symbol AS ticker, {bucket('6 hours', 'market_ts')} AS window_start_time, count(*) AS record_count,
       first(price ORDER BY market_ts, trade_id) AS price_at_window_start, min(price) AS min_price, max(price) AS max_price,
       last(price ORDER BY market_ts, trade_id) AS price_at_window_end,
       sum(lot_size) AS sum_quantity, sum(price * lot_size) AS sum_notional
FROM trades GROUP BY 1, 2"""

PARTS["tw"] = f"""
SELECT {measure(TRADE_WINDOWS, 'window_start_time')} AS measure_id, *,
       window_start_time + INTERVAL 6 HOUR AS window_end_time,
       CASE WHEN sum_quantity = 0 THEN 0.0 ELSE sum_notional / sum_quantity END AS volume_weighted_avg_price
FROM tw0"""

PARTS["sides"] = f"""
SELECT symbol AS ticker, {bucket('6 hours', 'market_ts')} AS w, 'ask' AS side, ask AS price, ask_lot AS lot, market_ts FROM quotes
UNION ALL
SELECT symbol, {bucket('6 hours', 'market_ts')}, 'bid', bid, bid_lot, market_ts FROM quotes"""

PARTS["medians"] = f"SELECT ticker, w, side, {median('price')} AS median FROM sides GROUP BY ALL"

PARTS["deviations"] = f"""
SELECT s.ticker, s.w, s.side, m.median, {median('abs(s.price - m.median)')} * {DEVIATION_SCALE} AS deviation
FROM sides s JOIN medians m USING (ticker, w, side) GROUP BY ALL"""

PARTS["flagged"] = f"""
SELECT s.*, d.median, d.deviation, abs(s.price - d.median) <= {OUTLIER_WIDTH} * d.deviation AS kept
FROM sides s JOIN deviations d USING (ticker, w, side)"""


def _side(name: str) -> str:
    return f"""
       min(price) FILTER (side = '{name}' AND kept) AS min_{name}_price,
       max(price) FILTER (side = '{name}' AND kept) AS max_{name}_price,
       sum(lot) FILTER (side = '{name}') AS sum_{name}_quantity,
       sum(price * lot) FILTER (side = '{name}') AS sum_{name}_notional,
       last(price ORDER BY market_ts, price) FILTER (side = '{name}') AS {name}_price_at_window_end"""


PARTS["qw0"] = f"""
SELECT ticker, w, count(*) FILTER (side = 'ask') AS record_count, {_side('ask')}, {_side('bid')}
FROM flagged GROUP BY ticker, w"""

PARTS["qw1"] = """
SELECT *, CASE WHEN sum_ask_quantity > 0 THEN sum_ask_notional / sum_ask_quantity ELSE 0.0 END AS volume_weighted_avg_ask_price,
       CASE WHEN sum_bid_quantity > 0 THEN sum_bid_notional / sum_bid_quantity ELSE 0.0 END AS volume_weighted_avg_bid_price
FROM qw0"""

PARTS["qw"] = f"""
SELECT {measure(QUOTE_WINDOWS, 'w')} AS measure_id, * EXCLUDE (w), w AS window_start_time,
       w + INTERVAL 6 HOUR AS window_end_time,
       volume_weighted_avg_ask_price - volume_weighted_avg_bid_price AS bid_ask_spread,
       (volume_weighted_avg_ask_price + volume_weighted_avg_bid_price) / 2 AS spread_midpoint,
       CASE WHEN sum_ask_quantity + sum_bid_quantity > 0
            THEN (sum_bid_quantity - sum_ask_quantity) / (sum_ask_quantity + sum_bid_quantity) ELSE 0.0 END AS order_imbalance
FROM qw1"""

_ZEROED = ", ".join(f"nullif({n}, 0) AS {n}" for n in [*QUOTE_FIELDS.values(), *TRADE_FIELDS.values()])

PARTS["merged"] = f"""
SELECT coalesce(q.ticker, t.ticker) AS ticker, coalesce(q.window_end_time, t.window_end_time) AS ts,
       {', '.join(f'q.{c} AS {n}' for c, n in QUOTE_FIELDS.items())},
       {', '.join(f't.{c} AS {n}' for c, n in TRADE_FIELDS.items())}
FROM qw q FULL JOIN tw t ON q.ticker = t.ticker AND q.window_end_time = t.window_end_time"""

PARTS["nonzero"] = f"SELECT ticker, ts, {_ZEROED} FROM merged"

PARTS["complete"] = f"SELECT * FROM nonzero WHERE {' AND '.join(f'{c} IS NOT NULL' for c in VWAPS + AMOUNTS)}"

PARTS["previous"] = f"""
SELECT *, {', '.join(f'lag({c}) OVER w AS prev_{c}' for c in VWAPS)} FROM complete
WINDOW w AS (PARTITION BY ticker ORDER BY ts)"""

PARTS["moved"] = f"""
SELECT * FROM previous WHERE vwap_price - prev_vwap_price <> 0 AND {' AND '.join(f'prev_{c} <> 0' for c in VWAPS)}"""

PARTS["lagged"] = """
SELECT a.*, b.vwap_ask AS prev_vwap_ask, b.vwap_bid AS prev_vwap_bid
FROM merged a JOIN merged b ON a.ticker = b.ticker AND a.ts = b.ts + INTERVAL 6 HOUR
WHERE a.vwap_price IS NOT NULL AND a.vwap_ask <> 0 AND a.vwap_bid <> 0 AND b.vwap_ask <> 0 AND b.vwap_bid <> 0"""


def metrics(source: str) -> tuple[str, str]:
    first = f"""
SELECT *, {rate('vwap_ask', 'vwap_bid')} AS spread_rate, {rate('prev_vwap_ask', 'prev_vwap_bid')} AS prev_spread_rate,
       {rate('prev_vwap_ask', 'vwap_ask')} AS ask_change_rate, {rate('vwap_bid', 'prev_vwap_bid')} AS bid_change_rate,
       (vwap_ask + vwap_bid) / 2 AS mid0
FROM {source}"""
    second = f"""
SELECT ts, ticker, ask_change_rate, bid_change_rate, bid_change_rate - ask_change_rate AS concession,
       CASE WHEN bid_notional + ask_notional > 0 THEN (bid_notional - ask_notional) / (bid_notional + ask_notional) ELSE 0.0 END
           AS imbalance,
       prev_spread_rate - spread_rate AS spread_change,
       CASE WHEN spread_rate > 0 THEN {rate('vwap_price', 'mid0')} / greatest(spread_rate, 0.01) ELSE 0.0 END AS trade_position,
       {', '.join(AMOUNTS)}
FROM {source}_1"""
    return first, second


PARTS["moved_1"], PARTS["moved_2"] = metrics("moved")
PARTS["lagged_1"], PARTS["lagged_2"] = metrics("lagged")

# Windows of one minute, averaged over steps of a quarter of an hour.
PARTS["stepped"] = f"""
SELECT ticker, {bucket('15 minutes', 'ts')} + INTERVAL 15 MINUTE AS ts,
       {', '.join(f'avg({c}) AS {c}' for c in [*QUOTE_FIELDS.values(), *TRADE_FIELDS.values()])}
FROM nonzero GROUP BY 1, 2"""
PARTS["stepped_complete"] = f"SELECT * FROM stepped WHERE {' AND '.join(f'{c} IS NOT NULL' for c in VWAPS + AMOUNTS)}"
PARTS["stepped_previous"] = PARTS["previous"].replace("FROM complete", "FROM stepped_complete")
PARTS["stepped_moved"] = PARTS["moved"].replace("FROM previous", "FROM stepped_previous")
PARTS["stepped_moved_1"], PARTS["stepped_moved_2"] = metrics("stepped_moved")

PARTS["from_open"] = f"""
SELECT ticker, ts, {', '.join(f"{pct(c, f'first_value({c} IGNORE NULLS) OVER w')} AS {c}" for c in VWAPS)}
FROM nonzero WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

PARTS["primitives"] = f"""
SELECT *, {', '.join(f'lag({c}) OVER w AS prev_{c}' for c in VWAPS)} FROM from_open
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in VWAPS)} WINDOW w AS (PARTITION BY ticker ORDER BY ts)"""

PARTS["primitive_moves"] = f"""
SELECT ts, ticker, prev_vwap_ask - vwap_ask AS ask_change, vwap_ask - vwap_bid AS spread, (vwap_bid + vwap_ask) / 2 AS mid
FROM primitives WHERE vwap_price - prev_vwap_price <> 0 AND {' AND '.join(f'prev_{c} <> 0' for c in VWAPS)}"""

PARTS["pressure"] = """
SELECT window_end_time AS ts, ticker,
       bid_price_at_window_end - lag(bid_price_at_window_end) OVER w AS db,
       ask_price_at_window_end - lag(ask_price_at_window_end) OVER w AS da,
       sum_bid_quantity AS bv, sum_ask_quantity AS av
FROM qw WINDOW w AS (PARTITION BY ticker ORDER BY window_end_time)"""

PARTS["pressed"] = """
SELECT ts, ticker, (db - da) * 0.5 + (bv - av) * 0.3
       + CASE WHEN abs(db) < 0.0005 THEN ln(1 + bv) ELSE 0.0 END * 0.2 AS value
FROM pressure WHERE db IS NOT NULL"""

# --- bars and index ------------------------------------------------------------

PARTS["bars"] = """
SELECT n_name AS ticker, l_shipdate + to_minutes(CAST(720 + l_orderkey % 20 * 30 AS INTEGER)) AS market_ts,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS volume,
       l_extendedprice / l_quantity AS high_price,
       l_extendedprice / l_quantity * (1 - l_discount) AS low_price,
       l_extendedprice / l_quantity * (1 - l_discount / 2) AS vwap,
       l_extendedprice / l_quantity * (1 - l_discount / 2) * l_quantity AS total_trading_value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

PARTS["local_bars"] = f"SELECT *, CAST({local('market_ts')} AS DATE) AS day FROM bars"

_SEQUENCE = "ORDER BY market_ts, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _daily(condition: str) -> str:
    return f"""
SELECT ticker, day, ticker || ' Inc' AS company, min(market_ts) AS market_ts,
       first(high_price {_SEQUENCE}) AS opening_price, last(low_price {_SEQUENCE}) AS closing_price,
       max(high_price) AS high_price, min(low_price) AS low_price, avg(vwap) AS volume_weighted_avg_price,
       sum(total_trading_value) AS total_trading_value
FROM local_bars WHERE {condition} GROUP BY ticker, day"""


PARTS["daily_regular"] = _daily(regular("market_ts"))
PARTS["daily_extended"] = _daily(bank_day("day"))


def _chain(kind: str) -> None:
    """Index chain: cohorts of members enter at the level of the day before."""
    PARTS[f"intro_{kind}"] = f"""
SELECT *, first_value(day) OVER w AS introduction_day, first_value(volume_weighted_avg_price) OVER w AS introduction_price,
       coalesce(lag(volume_weighted_avg_price) OVER w, volume_weighted_avg_price) AS prev_avg
FROM daily_{kind} WINDOW w AS (PARTITION BY ticker ORDER BY day)"""
    PARTS[f"sums_{kind}"] = f"""
SELECT day, introduction_day, sum(volume_weighted_avg_price / introduction_price) AS s, count(*) AS c
FROM intro_{kind} GROUP BY ALL"""
    PARTS[f"days_{kind}"] = f"""
SELECT day, lag(day) OVER (ORDER BY day) AS before, lag(sum(c)) OVER (ORDER BY day) AS present FROM sums_{kind} GROUP BY day"""
    PARTS[f"cohorts_{kind}"] = f"""
SELECT introduction_day, row_number() OVER (ORDER BY introduction_day) AS k
FROM (SELECT DISTINCT introduction_day FROM sums_{kind})"""
    PARTS[f"terms_{kind}"] = f"""
SELECT a.k, list(coalesce(s.s, 0.0) ORDER BY b.k) AS relatives, any_value(CAST(d.present AS DOUBLE)) AS present
FROM cohorts_{kind} a JOIN cohorts_{kind} b ON b.k < a.k JOIN days_{kind} d ON d.day = a.introduction_day
LEFT JOIN sums_{kind} s ON s.day = d.before AND s.introduction_day = b.introduction_day GROUP BY a.k"""
    PARTS[f"chain_{kind}"] = f"""
SELECT CAST(1 AS BIGINT) AS k, [CAST(1.0 AS DOUBLE)] AS levels
UNION ALL
SELECT t.k, list_append(c.levels, list_inner_product(c.levels, t.relatives) / t.present)
FROM chain_{kind} c JOIN terms_{kind} t ON t.k = c.k + 1"""
    PARTS[f"members_{kind}"] = f"""
SELECT i.ticker, i.day, CAST(i.day AS TIMESTAMP) AS ts, l.level / introduction_price * opening_price AS price_change_open,
       l.level / introduction_price * closing_price AS price_change_close,
       l.level / introduction_price * high_price AS price_change_high,
       l.level / introduction_price * low_price AS price_change_low,
       l.level / introduction_price * volume_weighted_avg_price AS price_change_avg,
       l.level / introduction_price * prev_avg AS prev_price_change_avg,
       total_trading_value, introduction_day, introduction_price, l.level AS index_value_when_introduced,
       volume_weighted_avg_price AS avg_price
FROM intro_{kind} i JOIN (
    SELECT introduction_day, levels[k] AS level FROM cohorts_{kind}, (SELECT levels FROM chain_{kind} ORDER BY k DESC LIMIT 1)
) l USING (introduction_day)"""
    PARTS[f"index_{kind}"] = f"""
SELECT day, CAST(day AS TIMESTAMP) AS ts, {', '.join(f'avg({c}) AS {c}' for c in CHANGES)},
       sum(total_trading_value) AS total_trading_value
FROM members_{kind} GROUP BY day"""


_chain("regular")
_chain("extended")


def week(ts: str = "ts") -> str:
    return f"{bucket('7 days', ts)} + INTERVAL 7 DAY"


def kama(name: str, source: str, n: int) -> None:
    """Kaufman's average of ``source(ts, value)``: seeded with row n, first output at row n + 1."""
    PARTS[f"{name}_rows"] = f"""
SELECT ts, value, row_number() OVER (ORDER BY ts) AS i, abs(value - lag(value, {n}) OVER (ORDER BY ts)) AS moved,
       abs(value - lag(value) OVER (ORDER BY ts)) AS step FROM {source}"""
    PARTS[f"{name}_weights"] = f"""
SELECT ts, value, i, pow(coalesce(moved / nullif(sum(step) OVER (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0), 0)
       * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS sc FROM {name}_rows"""
    PARTS[name] = f"""
SELECT i, ts, value AS level FROM {name}_weights WHERE i = {n}
UNION ALL
SELECT w.i, w.ts, k.level + w.sc * (w.value - k.level) FROM {name} k JOIN {name}_weights w ON w.i = k.i + 1"""


PARTS["avg_series"] = "SELECT ts, price_change_avg AS value FROM index_regular"
PARTS["log_series"] = "SELECT ts, ln(price_change_avg) AS value FROM index_regular WHERE price_change_avg > 0"
PARTS["weekly_log"] = f"""
SELECT {week()} AS ts, ln(arg_max(price_change_avg, ts)) AS value FROM index_regular GROUP BY 1"""
PARTS["feature_rows"] = f"""
SELECT day, CAST(day AS TIMESTAMP) AS ts, ln(price_change_high) AS value, total_trading_value
FROM index_regular WHERE day >= DATE '1995-06-01'"""

kama("kama10", "avg_series", 10)
kama("kama_log", "log_series", 42)
kama("kama_weekly", "weekly_log", 60)
kama("kama42", "feature_rows", 42)
kama("kama85", "feature_rows", 85)


def ma(source: str, n: int, value: str = "value") -> str:
    return f"""
SELECT *, avg({value}) OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS average,
       row_number() OVER (ORDER BY ts) AS position FROM {source}"""


def level(field: str, provisional: str | None = None, by: str = "") -> str:
    column = f"price_change_{field}"
    counted = f"CASE WHEN ts < TIMESTAMP '{provisional}' THEN {column} END" if provisional else column
    over = f"OVER ({by} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"{column} / nullif(greatest(0.0, {column}, coalesce(max({counted}) {over}, 0.0)), 0) * 100 AS drawdown_{field}"


def drawdown(source: str, provisional: str | None = None, by: str = "", keys: str = "") -> str:
    columns = ", ".join(f"price_change_{f}" for f in ("low", "avg", "high"))
    levels = ", ".join(level(f, provisional, by) for f in ("low", "avg", "high"))
    return f"SELECT {keys} ts, {columns}, {levels} FROM {source}"


PARTS["drawdown"] = drawdown("index_regular")


def labels(forward: int, start: str | None = None, source: str = "drawdown") -> str:
    where = f"WHERE ts >= TIMESTAMP '{start}'" if start else ""
    forward_level = (
        f"coalesce(min(drawdown_low) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {forward} FOLLOWING), drawdown_low)"
        if forward
        else "drawdown_low"
    )
    dips = ", ".join(
        f"i - coalesce(max(CASE WHEN drawdown_low <= {limit} THEN i END) OVER (ORDER BY ts), 0) AS days_since_dip_of_{size}"
        for size, limit in DIP_LEVELS.items()
    )
    return f"""
SELECT ts, drawdown_low AS current_drawdown, lead(drawdown_low, 1, 0.0) OVER (ORDER BY ts) AS drawdown_next_bank_day,
       {dips}, {forward_level} AS forward_max_drawdown
FROM (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM {source} {where})"""


PARTS["labels_all"] = labels(25)
for _forward in (0, 10, 25):
    PARTS[f"labels_{_forward}"] = labels(_forward, "1995-06-01")

PARTS["vix_raw"] = """
SELECT CAST(o_orderdate AS DATE) AS day,
       CASE WHEN dayofyear(o_orderdate) % 5 = 0 THEN NULL ELSE round(avg(o_totalprice) / 1000, 9) END AS v
FROM orders GROUP BY 1, dayofyear(o_orderdate)"""
PARTS["vix"] = """
SELECT 'VIX' AS ticker, day, last_value(v IGNORE NULLS) OVER w AS value,
       CASE WHEN v IS NULL THEN last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER w END AS carry_forward_from
FROM vix_raw WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

PARTS["top_members"] = """
SELECT ticker FROM members_extended WHERE day >= (SELECT max(day) FROM members_extended) - 15
GROUP BY ticker ORDER BY sum(total_trading_value) DESC, ticker LIMIT 10"""
PARTS["spread"] = f"""
SELECT day, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25) + quantile_cont(v, 0.9) - quantile_cont(v, 0.1)) / 2
       AS members_daily_spread
FROM (SELECT day, {pct('price_change_avg', 'prev_price_change_avg')} AS v FROM members_extended
      WHERE day >= DATE '1995-06-01' AND ticker IN (SELECT ticker FROM top_members)) GROUP BY day"""

for _n in (42, 85):
    PARTS[f"ma{_n}"] = ma("feature_rows", _n)
    PARTS[f"mv{_n}"] = ma("feature_rows", _n, "total_trading_value")


PARTS["index_doubled"] = """
SELECT day, ts + INTERVAL 12 HOUR AS ts, price_change_low, price_change_avg, price_change_high, total_trading_value FROM index_regular
UNION ALL
SELECT day, ts, price_change_low * 1.01, price_change_avg * 1.01, price_change_high * 1.01, total_trading_value * 1.01 FROM index_regular"""
PARTS["drawdown_doubled"] = drawdown("index_doubled")
PARTS["labels_0_doubled"] = labels(0, "1995-06-01", "drawdown_doubled")
PARTS["feature_rows_doubled"] = """
SELECT day, ts, ln(price_change_high) AS value, total_trading_value FROM index_doubled WHERE day >= DATE '1995-06-01'"""
kama("kama42_doubled", "feature_rows_doubled", 42)
PARTS["ma42_doubled"] = ma("feature_rows_doubled", 42)
PARTS["mv42_doubled"] = ma("feature_rows_doubled", 42, "total_trading_value")


def features(program: feat.Program, of: str = "") -> str:
    return f"""
SELECT CAST(l.ts AS DATE) AS day, l.{program.label}, s.members_daily_spread,
       m.value - m.average AS index_over_moving_avg, m.value - k.level AS index_over_kaufman_avg,
       v.total_trading_value - v.average AS volume_over_moving_avg, l.current_drawdown,
       {', '.join(f'l.days_since_dip_of_{d}' for d in DIP_LEVELS)}, x.value AS vix
FROM labels_{program.forward_days}{of} l
JOIN ma{program.index_days}{of} m ON m.ts = l.ts AND m.position >= {program.index_days}
JOIN kama{program.index_days}{of} k ON k.ts = l.ts AND k.i > {program.index_days}
JOIN mv{program.volume_days}{of} v ON v.ts = l.ts AND v.position >= {program.volume_days}
JOIN spread s ON s.day = CAST(l.ts AS DATE)
JOIN vix x ON x.day = CAST(l.ts AS DATE) AND x.value IS NOT NULL"""


for _program in feat.PROGRAMS:
    PARTS[f"features_{_program.variant.replace('-', '_') or 'next_day'}"] = features(_program)


PARTS["features_doubled"] = features(feat.NEXT_BANK_DAY, "_doubled") + " WHERE hour(l.ts) = 12"


def shown_features(program: feat.Program, source: str) -> str:
    columns = []
    for c in program.columns:
        if c.startswith("days_since"):
            columns.append(f"CAST({c} AS INTEGER) AS {c}")
        else:
            columns.append(r(c))
    return f"SELECT day, {', '.join(columns)} FROM {source}"


# --- feed, financials ------------------------------------------------------------

PARTS["feed"] = """
SELECT event_id, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       CASE event_type WHEN 'signup' THEN 'stock_quotation' WHEN 'error' THEN 'subscription' WHEN 'view' THEN 'unknown'
            ELSE 'stock_trade' END AS route
FROM events"""

PARTS["totals"] = """
SELECT c_mktsegment AS ticker, year(o_orderdate) AS y, quarter(o_orderdate) AS q, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
PARTS["yearly"] = "SELECT ticker, y, round(sum(total), 2) AS total FROM totals GROUP BY ALL"
PARTS["companies"] = "SELECT DISTINCT ticker FROM totals"


def items() -> str:
    columns = []
    for n, name in enumerate(ITEMS):
        share = f"total * {(n + 1) / 100}"
        columns.append(f"CAST(trunc({share}) AS BIGINT) AS {name}" if name in AMOUNT_ITEMS else r(f"({share})", name))
    return ", ".join(columns)


PARTS["quarter_reports"] = f"""
SELECT c.ticker, CAST(p.y AS VARCHAR) || 'Q' || p.q AS report_period, CAST(p.y AS INTEGER) AS fiscal_year, 'Q' || p.q AS period,
       'USD' AS currency, {items()}
FROM companies c CROSS JOIN (SELECT y, q FROM range(1995, 2002) a(y), range(1, 5) b(q) WHERE y * 4 + q < 2001 * 4 + 4) p
LEFT JOIN totals t ON t.ticker = c.ticker AND t.y = p.y AND t.q = p.q"""

PARTS["universe"] = """
SELECT s_suppkey AS row_id,
       CASE WHEN s_acctbal < 0 THEN lower(chr(65 + s_nationkey) || chr(CAST(65 + s_suppkey % 26 AS INTEGER)))
            ELSE chr(65 + s_nationkey) || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) END AS ticker,
       CASE WHEN s_suppkey % 17 = 0 THEN ' ' ELSE s_name END AS company
FROM supplier"""

PARTS["starts"] = f"""
SELECT s_name AS ticker, max(l_shipdate) AS start FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_name
UNION ALL
SELECT s_name || n.suffix, {utc("TIMESTAMP '1995-01-01'")} FROM supplier, (VALUES (''), ('.NEW')) n(suffix)
WHERE n.suffix <> '' OR s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)"""


def _closed(source: str) -> str:
    return f"{source} WHERE window_end_time <= (SELECT max(ts) - INTERVAL 120 SECOND FROM events)"


def _deltas(source: str, names: list[str], measurement: str) -> str:
    changes = ", ".join(f"{m} - lag({m}) OVER w AS {m}_delta" for m in names)

    def shown(m: str) -> str:
        if m == "record_count":
            return "CAST(record_count_delta AS BIGINT) AS record_count_delta"
        return r(f"{m}_delta")

    return f"""
SELECT {measure(measurement, 'timestamp')} AS measure_id, ticker, timestamp, {', '.join(shown(m) for m in names)}
FROM (SELECT ticker, window_end_time AS timestamp, lag(window_end_time) OVER w AS before, {changes}
      FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY window_end_time)) WHERE before IS NOT NULL"""


def _trade_window_columns() -> str:
    exact = ["price_at_window_start", "min_price", "max_price", "price_at_window_end", "volume_weighted_avg_price"]
    return (
        "measure_id, ticker, window_start_time, window_end_time, record_count, "
        + rs(*exact) + ", " + rs("sum_quantity", "sum_notional")
    )


def _quote_window_columns() -> str:
    return "measure_id, ticker, window_start_time, window_end_time, record_count, " + rs(*QUOTE_METRICS[1:])


def _metric_columns() -> str:
    sign = "CASE WHEN {0} > 1e-9 THEN 1 WHEN {0} < -1e-9 THEN -1 ELSE 0 END"
    rates = ["ask_change_rate", "bid_change_rate", "concession", "imbalance", "spread_change", "trade_position"]
    return (
        f"ts, ticker, {rs(*rates)}, {r('concession * 0.5', 'mid_change')}, "
        f"CAST({sign.format('concession')} = {sign.format('trade_position')} AS INTEGER) AS agree, "
        f"{r('(1 + concession) * trade_position', 'agree_score')}, {rs(*AMOUNTS)}"
    )


def _reasons(checks: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in checks.items())
    return f"concat_ws(',', {cases})"


def _members(names: str = "") -> str:
    return ", ".join([*[r(c) for c in CHANGES], r("total_trading_value")]) + names


def _long(source: str, fields: dict[str, str], group: str = week()) -> str:
    return " UNION ALL ".join(
        f"SELECT {group} AS ts, '{alias}' AS field, {expression} AS value FROM {source} GROUP BY 1" for alias, expression in fields.items()
    )


def statements() -> dict[str, str]:
    bands = {"a_low": "min(price_change_low)", "b_high": "max(price_change_high)"}
    last_day = utc("CAST(last_day(day) AS TIMESTAMP)")
    bar_checks = {
        "opening_price": "CASE WHEN trade_id % 11 = 0 THEN 0 ELSE price END > 0",
        "closing_price": "CASE WHEN trade_id % 13 = 0 THEN -price ELSE price END > 0",
        "high_price": "CASE WHEN trade_id % 17 = 0 THEN NULL ELSE price END > 0",
        "low_price": "CASE WHEN trade_id % 19 = 0 THEN 0 ELSE price END > 0",
        "volume_weighted_avg_price": "CASE WHEN trade_id % 23 = 0 THEN -price ELSE price END > 0",
        "volume": "lot_size > 0",
    }
    universe_checks = {"ticker": "regexp_full_match(ticker, '[A-Z.]{1,5}')", "company": "trim(company) <> ''"}
    flow = "CASE WHEN price_change_avg > prev_price_change_avg THEN total_trading_value ELSE -total_trading_value END"
    move = pct("price_change_avg", "prev_price_change_avg")
    share = "member * idx / (pow(idx, 2) + 0.5)"
    fixed4 = "CAST(CAST(" + shown_sql("{0}") + " AS VARCHAR) AS DECIMAL(38,10))"
    nanos = "CAST(CAST(epoch({0}) AS BIGINT) * 1000000000 AS VARCHAR)"
    line_fields = [
        "'measure_id=\"' || measure_id || '\"'",
        f"'window_start_time=' || {nanos.format('window_start_time')} || 'i'",
        f"'window_end_time=' || {nanos.format('window_end_time')} || 'i'",
        "'record_count=' || record_count || 'i'",
        *[
            f"'{c}=' || {fixed4.format(c)}"
            for c in ("price_at_window_start", "min_price", "max_price", "price_at_window_end", "sum_quantity", "sum_notional", "volume_weighted_avg_price")
        ],
    ]

    def attribution(condition: str) -> str:
        return f"""
SELECT ticker, ts, {r('sum(v) OVER (PARTITION BY ticker ORDER BY ts)', 'value')}
FROM (SELECT m.ticker, m.ts, {share} AS v
      FROM (SELECT ticker, ts, {move} AS member FROM members_regular) m
      JOIN (SELECT ts, {move} AS idx FROM index_regular) i USING (ts) WHERE {condition})"""

    def trend(shift_ma: int, shift_kama: int, base: str, adaptive: str, n: int, first: str) -> str:
        return f"""
SELECT ts, field, {r('value')} FROM (
  {first}
  UNION ALL SELECT ts - INTERVAL {shift_ma} DAY, 'moving_average', average FROM ({ma(base, n)}) WHERE position >= {n}
  UNION ALL SELECT ts - INTERVAL {shift_kama} DAY, 'kaufman_average', level FROM {adaptive} WHERE i > {n})"""

    def point(c: str, program: feat.Program) -> str:
        if c.startswith("days_since"):
            return f"'{c}=' || {c} || 'i'"
        return f"'{c}=' || CAST(CAST({shown_sql(c)} AS VARCHAR) AS DECIMAL(38,6))"

    two_weeks = feat.FORWARD_TWO_WEEKS
    out = {
        # live windows
        "trade_windows": f"SELECT {_trade_window_columns()} FROM tw",
        "quote_windows": f"SELECT {_quote_window_columns()} FROM qw",
        "window_medians": f"""
SELECT ticker, w + INTERVAL 6 HOUR AS window_end_time, side, {r('max(median)', 'median')}, {r('max(deviation)', 'deviation')},
       count(*) AS quotes, count(*) FILTER (kept) AS kept FROM flagged GROUP BY ticker, w, side""",
        "trade_deltas": _deltas("tw", TRADE_METRICS, TRADE_DELTAS),
        "quote_deltas": _deltas("qw", QUOTE_METRICS, QUOTE_DELTAS),
        "microstructure_metrics": f"SELECT {_metric_columns()} FROM moved_2",
        "microstructure_stepped": f"SELECT {_metric_columns()} FROM stepped_moved_2",
        "microstructure_cumulative": f"""
SELECT ts, ticker, 'mid_change' AS field, {r('sum(concession * 0.5) OVER (PARTITION BY ticker ORDER BY ts)', 'value')} FROM moved_2""",
        "microstructure_lagged": f"SELECT {_metric_columns()} FROM lagged_2",
        "microstructure_primitives": f"""
SELECT ts, ticker, {rs(*VWAPS)}, {rs(*[f'prev_{c}' for c in VWAPS])}, {r('prev_vwap_ask - vwap_ask', 'ask_change')},
       {r('vwap_bid - prev_vwap_bid', 'bid_change')}, {r('vwap_ask - vwap_bid', 'spread')}, {r('(vwap_bid + vwap_ask) / 2', 'mid')}
FROM primitives WHERE vwap_price - prev_vwap_price <> 0 AND {' AND '.join(f'prev_{c} <> 0' for c in VWAPS)}""",
        "primitives_cumulative": f"""
SELECT ts, ticker, field, {r('value')} FROM (
  SELECT ts, ticker, 'ask_change' AS field, sum(ask_change) OVER (PARTITION BY ticker ORDER BY ts) AS value FROM primitive_moves
  UNION ALL SELECT ts, ticker, 'spread', sum(spread) OVER (PARTITION BY ticker ORDER BY ts) FROM primitive_moves
  UNION ALL SELECT ts, ticker, 'mid', mid FROM primitive_moves)""",
        "bid_ask_ratio": f"""
SELECT window_end_time AS ts, ticker,
       {r('tanh((sum_bid_notional - sum_ask_notional) / nullif(sum_bid_notional + sum_ask_notional, 0))', 'value')} FROM qw""",
        "bid_ask_ratio_basket": f"""
SELECT window_end_time AS ts, 'BASKET' AS ticker,
       {r('avg(tanh((sum_bid_notional - sum_ask_notional) / nullif(sum_bid_notional + sum_ask_notional, 0)))', 'value')}
FROM qw GROUP BY 1""",
        "institutional_pressure": f"SELECT ts, ticker, {r('value')} FROM pressed",
        "institutional_pressure_basket": f"SELECT ts, 'BASKET' AS ticker, {r('avg(value)', 'value')} FROM pressed GROUP BY ts",
        "quote_totals": f"""
SELECT window_end_time AS ts, {r('sum(sum_ask_notional)', 'asks')}, {r('sum(sum_bid_notional)', 'bids')} FROM qw GROUP BY 1""",
        "quote_totals_by_ticker": f"""
SELECT window_end_time AS ts, ticker, {r('sum_ask_notional', 'asks')}, {r('sum_bid_notional', 'bids')} FROM qw WHERE ticker <> 'click'""",
        "trade_notional": f"""
SELECT window_end_time AS ts, ticker, {r('sum_notional', 'value')} FROM tw WHERE ticker NOT IN ('click', 'view')""",
        "windowed_quotations": f"""
SELECT measure_id, ticker AS symbol, window_start_time, window_end_time, {r('sum_bid_quantity', 'sum_bid_volume')},
       {r('sum_ask_quantity', 'sum_ask_volume')}, record_count, {r('volume_weighted_avg_bid_price', 'average_bid_price')},
       {r('volume_weighted_avg_ask_price', 'average_ask_price')}, {rs('bid_price_at_window_end', 'ask_price_at_window_end')} FROM qw""",
        "line_protocol": f"""
SELECT concat_ws(' ', '{TRADE_WINDOWS},ticker=' || ticker, concat_ws(',', {', '.join(line_fields)}),
       {nanos.format('window_end_time')}) AS value FROM tw""",
        "subscriber_batches": """
SELECT CAST(c_custkey AS VARCHAR) AS connection_id, symbol, batch, CAST(count(*) AS INTEGER) AS size,
       string_agg(measure_id, ',' ORDER BY n) AS ids
FROM customer JOIN (
    SELECT ticker AS symbol, measure_id, row_number() OVER w - 1 AS n,
           CAST(floor((row_number() OVER w - 1) / 7) AS BIGINT) AS batch
    FROM tw WINDOW w AS (PARTITION BY ticker ORDER BY window_end_time, measure_id)
) ON symbol = list_extract(['click', 'error', 'purchase', 'signup', 'view'], c_custkey % 5 + 1)
GROUP BY c_custkey, symbol, batch""",
        "latest_per_id": f"""
SELECT user_id AS id, ts, event_id, event_type, {r('value')}
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
        "chart_points": f"""
SELECT ticker, window_end_time AS ts, {r('(hour(window_end_time) * 3600 + minute(window_end_time) * 60 + second(window_end_time)) / 86399.0 * 1000', 'x')},
       {r('(sum_notional - hi * 1.02) * 400 / nullif(lo * 0.98 - hi * 1.02, 0)', 'y')}, {r('price_at_window_end', 'price')},
       {r('sum_notional', 'value')}
FROM (SELECT *, min(sum_notional) OVER (PARTITION BY ticker) AS lo, max(sum_notional) OVER (PARTITION BY ticker) AS hi
      FROM tw WHERE price_at_window_end > 0 AND sum_notional > 0)""",
        "throughput": "SELECT date_trunc('minute', ts) AS minute, count(*) AS messages FROM events GROUP BY 1",
        # feed
        "route_messages": "SELECT route, count(*) AS messages, CAST(sum(event_id) AS BIGINT) AS ids FROM feed GROUP BY route",
        "decoded_trades": f"""
SELECT event_type AS symbol, 'stock' AS asset, event_id AS trade_id, ts AS market_ts, {r('value', 'price')}, {r('k', 'lot_size')},
       'X' AS exchange, 'USD' AS currency, 'A' AS tape FROM feed WHERE route = 'stock_trade' AND k NOT IN (7, 11, 13)""",
        "rejected_trades": """
SELECT event_type AS symbol, event_id AS trade_id,
       CASE k WHEN 7 THEN 'settle_price' WHEN 11 THEN 'market_ts_range' ELSE 'market_ts,ingest_ts,market_ts_range' END AS reasons
FROM feed WHERE route = 'stock_trade' AND k IN (7, 11, 13)""",
        "decoded_quotes": f"""
SELECT event_type AS symbol, 'stock' AS asset, ts AS market_ts, {r('value', 'ask_price')}, {r('k', 'ask_lot')}, {r('value', 'bid_price')},
       {r('k', 'bid_lot')}, 'A' AS tape FROM feed WHERE route = 'stock_quotation' AND k NOT IN (7, 11, 13)""",
        "rejected_quotes": """
SELECT event_type AS symbol,
       CASE k WHEN 7 THEN 'bid_price,ask_price' WHEN 11 THEN 'market_ts_range' ELSE 'market_ts,ingest_ts,market_ts_range' END AS reasons,
       count(*) AS quotes
FROM feed WHERE route = 'stock_quotation' AND k IN (7, 11, 13) GROUP BY ALL""",
        "money_split": f"""
SELECT o_orderkey AS id, CAST(trunc(o_totalprice) AS BIGINT) AS units,
       CAST(round((o_totalprice - trunc(o_totalprice)) * 1000000000) AS INTEGER) AS nanos, 'USD' AS currency,
       {r('o_totalprice', 'amount')} FROM orders""",
        # bars and calendar
        "bar_validation": f"""
SELECT symbol AS ticker, trade_id, market_ts, {r('price * lot_size', 'total_trading_value')},
       {regular('market_ts')} AS regular_trading_hours FROM trades WHERE {' AND '.join(bar_checks.values())}""",
        "bar_rejections": f"""
SELECT symbol AS ticker, trade_id, {_reasons(bar_checks)} AS reasons FROM trades
WHERE NOT coalesce({' AND '.join(bar_checks.values())}, false)""",
        **{
            f"daily_bars{suffix}": f"""
SELECT ticker, day, company, market_ts, {rs('opening_price', 'closing_price', 'high_price', 'low_price', 'volume_weighted_avg_price')},
       {rs('total_trading_value')} FROM daily_{kind}"""
            for suffix, kind in (("", "regular"), ("_extended", "extended"))
        },
        "monthly_volumes": f"""
SELECT ticker, strftime(day, '%Y-%m') AS month, {r('sum(total_trading_value)', 'total_trading_value')}
FROM local_bars WHERE market_ts < {last_day} GROUP BY 1, 2""",
        "top_tickers": f"""
SELECT ticker, {r('sum(total_trading_value)', 'total_trading_value')} FROM local_bars
WHERE strftime(day, '%Y-%m') = '2000-06' GROUP BY ticker ORDER BY 2 DESC, ticker LIMIT 10""",
        "time_bounds": "SELECT ticker, min(market_ts) AS earliest, max(market_ts) AS latest FROM bars GROUP BY ticker",
        "first_since": f"""
SELECT ticker, min(market_ts) AS market_ts, {r(f'first(low_price {_SEQUENCE})', 'closing_price')}
FROM bars WHERE market_ts >= TIMESTAMP '1996-01-01' GROUP BY ticker""",
        "stale_tickers": """
SELECT l_suppkey AS ticker, min(l_shipdate) AS earliest, max(l_shipdate) AS latest FROM lineitem GROUP BY 1
HAVING max(l_shipdate) < (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 7 DAY""",
        "scan_starts": "SELECT ticker, start FROM starts",
        "earliest_touched": "SELECT CAST(min(start) AS DATE) AS stale_from FROM starts",
        "universe_rejections": f"""
SELECT row_id, {_reasons(universe_checks)} AS reasons FROM universe WHERE NOT ({' AND '.join(universe_checks.values())})""",
        "universe_duplicates": """
SELECT 'ticker' AS field, ticker AS value, count(*) AS occurrences FROM universe GROUP BY ticker HAVING count(*) > 1
UNION ALL
SELECT 'company', company, count(*) FROM universe GROUP BY company HAVING count(*) > 1""",
        "tickers_without_rows": """
SELECT ticker, p_name FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN -p_partkey ELSE p_partkey END AS ticker, p_name FROM part)
WHERE ticker NOT IN (SELECT l_partkey FROM lineitem)""",
        **{
            name: f"""
SELECT day, {weekend('day')} AS is_weekend, {holiday('day')} AS is_holiday, {bank_day('day')} AS is_bank_day,
       {seek('day', -1)} AS previous_bank_day, {seek('day', 1)} AS next_bank_day
FROM (SELECT DISTINCT {days})"""
            for name, days in (
                ("calendar", "CAST(l_shipdate AS DATE) AS day FROM lineitem"),
                ("calendar_later", "CAST(CAST(o_orderdate AS DATE) + 8766 AS DATE) AS day FROM orders"),
            )
        },
        "session_bounds": f"""
SELECT day, CASE WHEN {bank_day('day')} THEN {utc("day + INTERVAL '9:30:00'")} END AS open_utc,
       CASE WHEN {bank_day('day')} THEN {utc("day + INTERVAL 16 HOUR")} - INTERVAL 1 MILLISECOND END AS close_utc,
       {utc('CAST(day AS TIMESTAMP)')} AS day_open_utc,
       {utc('CAST(day AS TIMESTAMP)')} + INTERVAL 24 HOUR - INTERVAL 1 MILLISECOND AS day_close_utc
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)""",
        "vix_forward_fill": f"SELECT ticker, day, {r('value')}, carry_forward_from FROM vix WHERE value IS NOT NULL",
        # index
        **{
            f"index_members{suffix}": f"""
SELECT ticker, day, ts, {_members()}, introduction_day, {rs('introduction_price', 'index_value_when_introduced', 'avg_price')}
FROM members_{kind}"""
            for suffix, kind in (("", "regular"), ("_extended", "extended"))
        },
        "member_state": f"""
SELECT ticker, min(introduction_day) AS introduction_day, {r('any_value(introduction_price)', 'introduction_price')},
       {r('any_value(index_value_when_introduced)', 'index_value_when_introduced')}, max(day) AS prev_day,
       {r('arg_max(avg_price, day)', 'prev_avg_price')}
FROM members_regular WHERE day < DATE '1998-01-01' GROUP BY ticker""",
        "index_daily": f"SELECT day, ts, {_members()} FROM index_regular",
        "index_geometric": f"""
SELECT day, CAST(day AS TIMESTAMP) AS ts, {', '.join(r(f'exp(avg(ln({c})))', c) for c in CHANGES)},
       {r('sum(total_trading_value)', 'total_trading_value')} FROM members_regular GROUP BY day""",
        "index_recompute": f"""
SELECT ticker, day, {rs('price_change_avg', 'prev_price_change_avg')} FROM members_regular WHERE day >= DATE '2001-01-02'""",
        "price_change_months": f"""
SELECT ticker, CAST(date_trunc('month', day) AS DATE) AS period, min(ts) AS ts, {r('arg_min(price_change_open, ts)', 'price_change_open')},
       {r('arg_max(price_change_close, ts)', 'price_change_close')}, {r('max(price_change_high)', 'price_change_high')},
       {r('min(price_change_low)', 'price_change_low')}, {r('avg(price_change_avg)', 'price_change_avg')},
       {r('avg(prev_price_change_avg)', 'prev_price_change_avg')}, {r('sum(total_trading_value)', 'total_trading_value')}
FROM members_regular GROUP BY 1, 2""",
        "long_series": " UNION ALL ".join(
            f"SELECT ts, '{c}' AS _field, {r(c, '_value')} FROM index_regular"
            for c in ("price_change_avg", "price_change_low", "price_change_high")
        ),
        "wide_series": f"SELECT ts, {rs('price_change_avg', 'price_change_low')} FROM index_regular",
        "moving_average": f"SELECT ts, {r('average', 'moving_average')} FROM ({ma('avg_series', 42)}) WHERE position >= 42",
        "kaufman_average": f"SELECT ts, {r('level', 'kaufman_average')} FROM kama10 WHERE i > 10",
        "index_level": f"SELECT {week()} AS ts, {r('avg(price_change_avg)', 'value')} FROM index_regular GROUP BY 1",
        "index_trend": trend(
            21, 6, "log_series", "kama_log", 42,
            f"SELECT {week()} AS ts, 'price_change_avg' AS field, avg(value) AS value FROM log_series GROUP BY 1",
        ),
        "index_trend_weekly": trend(
            90, 90, "weekly_log", "kama_weekly", 60, "SELECT ts, 'price_change_avg' AS field, value FROM weekly_log"
        ),
        "index_bands": f"""
SELECT ts, field, {r('ln(value)', 'value')} FROM ({_long('index_regular', {**bands, 'c_avg': 'avg(price_change_avg)'})})""",
        "index_bands_linear": f"""
SELECT ts, field, {r('value')} FROM ({_long('index_regular', {**bands, 'c_avg': median('price_change_avg')})})""",
        "index_change": f"""
SELECT ts, field, {r('value')} FROM (
  SELECT ts + INTERVAL 1 DAY AS ts, 'a_daily' AS field, {move} AS value FROM index_regular
  UNION ALL SELECT {week()}, 'b_weekly', avg({move}) FROM index_regular GROUP BY 1)""",
        "index_volume": f"""
SELECT ts, field, {r('value')} FROM (
  {_long('index_regular', {'volume': 'avg(total_trading_value / nullif(price_change_avg, 0))', 'dollar_value': 'avg(total_trading_value)'})}
  UNION ALL SELECT {bucket('42 days', 'ts')} + INTERVAL 42 DAY - INTERVAL 8 DAY, 'custom_moving_average', avg(total_trading_value)
  FROM index_regular GROUP BY 1)""",
        "index_volume_by_month": f"""
SELECT make_date(CAST(n // 12 AS INTEGER), CAST(n % 12 + 1 AS INTEGER), 1) - INTERVAL 49 DAY AS ts, {r('value')}
FROM (SELECT (year(ts) * 12 + month(ts) - 1) // 4 * 4 + 4 AS n, avg(value) AS value
      FROM (SELECT {week()} AS ts, avg(total_trading_value) AS value FROM index_regular GROUP BY 1) GROUP BY 1)""",
        "weekly_unit_volume": f"""
SELECT g.ts, {r('value')} FROM (
  SELECT unnest(generate_series(min({week()}), max({week()}), INTERVAL 7 DAY)) AS ts FROM index_regular) g
LEFT JOIN (SELECT {week()} AS ts, avg(total_trading_value) / nullif(avg(price_change_avg), 0) AS value FROM index_regular GROUP BY 1) v
ON v.ts = g.ts""",
        "index_flow": f"SELECT ts, {r(flow, 'value')} FROM index_regular",
        "annualised_gain": f"""
SELECT ts, {r("(pow(value, 1.0 / (datediff('day', DATE '1995-01-01', CAST(ts AS DATE)) / 365.0)) - 1) * 100", 'value')} FROM (
  SELECT g.ts, v.value FROM (
    SELECT unnest(generate_series(min(b), max(b), INTERVAL 14 DAY)) AS ts
    FROM (SELECT {bucket('14 days', 'ts')} + INTERVAL 14 DAY AS b FROM index_regular WHERE ts > TIMESTAMP '1996-01-01' AND price_change_avg > 1)) g
  LEFT JOIN (SELECT {bucket('14 days', 'ts')} + INTERVAL 14 DAY AS ts, {median('price_change_avg')} AS value
             FROM index_regular WHERE ts > TIMESTAMP '1996-01-01' AND price_change_avg > 1 GROUP BY 1) v ON v.ts = g.ts)""",
        "drawdown": f"SELECT ts, {rs(*[f'price_change_{f}' for f in ('low', 'avg', 'high')], *[f'drawdown_{f}' for f in ('low', 'avg', 'high')])} FROM drawdown",
        "drawdown_provisional": f"""
SELECT ts, {rs(*[f'price_change_{f}' for f in ('low', 'avg', 'high')], *[f'drawdown_{f}' for f in ('low', 'avg', 'high')])}
FROM ({drawdown('index_regular', '2001-01-01')})""",
        "member_drawdown": f"""
SELECT ticker, ts, {rs(*[f'price_change_{f}' for f in ('low', 'avg', 'high')], *[f'drawdown_{f}' for f in ('low', 'avg', 'high')])}
FROM ({drawdown('members_regular', by='PARTITION BY ticker', keys='ticker,')})""",
        "drawdown_bands": f"""
SELECT ts, field, {r('value')} FROM ({_long('drawdown', {'a_low': 'min(drawdown_low)', 'b_high': 'max(drawdown_high)', 'c_avg': 'avg(drawdown_avg)'})})""",
        "drawdown_labels": f"""
SELECT ts, {rs('current_drawdown', 'drawdown_next_bank_day', 'forward_max_drawdown')},
       {', '.join(f'CAST(days_since_dip_of_{d} AS INTEGER) AS days_since_dip_of_{d}' for d in DIP_LEVELS)} FROM labels_all""",
        "linear_regression": f"""
SELECT ticker, count(*) AS points, {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept')},
       {r('(regr_syy(y, x) - pow(regr_slope(y, x), 2) * regr_sxx(y, x)) / count(*)', 'variance')}
FROM (SELECT ticker, (price_change_avg / first_value(price_change_avg) OVER w - 1) * 100 AS y,
             CAST(row_number() OVER w - 1 AS DOUBLE) AS x
      FROM members_regular WINDOW w AS (PARTITION BY ticker ORDER BY ts)) GROUP BY ticker""",
        "largest_deviation": f"""
SELECT ticker, year, position, {rs('price_change_avg', 'residual')} FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY residual DESC, position) AS best FROM (
    SELECT b.ticker, b.year, CAST(a.position AS INTEGER) AS position, b.price_change_avg,
           0.2 * (abs(b.price_change_avg - a.price_change_avg) / (1 + abs(a.position - floor((b.n - 7) / 2))))
           + 0.8 * abs(b.price_change_avg - a.price_change_avg) AS residual
    FROM numbered a JOIN numbered b ON a.ticker = b.ticker AND a.year = b.year AND b.position = a.position + 7)) WHERE best = 1""",
        # members
        "member_trends": f"""
SELECT ticker, ts, {r('ln(value)', 'value')} FROM (
  SELECT ticker, {week()} AS ts, avg(price_change_avg) AS value FROM members_regular GROUP BY 1, 2) WHERE value > 0.667""",
        "member_daily_change": f"SELECT ticker, ts, {r(f'10000 * tanh(({move}) * 0.3)', 'value')} FROM members_regular",
        "member_volumes": f"""
SELECT ticker, {week()} AS ts, {r('arg_max(total_trading_value, ts)', 'value')} FROM members_regular GROUP BY 1, 2""",
        "member_flow": f"SELECT ticker, ts, {r(flow, 'value')} FROM members_regular WHERE ticker <> 'NATION_1'",
        "member_attribution": attribution("true"),
        "member_attribution_flat": attribution("idx BETWEEN -0.2 AND 0.2"),
        # features
        "member_spread": f"SELECT day, {r('members_daily_spread')} FROM spread",
        "features_next_day": shown_features(feat.NEXT_BANK_DAY, "features_next_day"),
        "features_doubled_days": shown_features(feat.NEXT_BANK_DAY, "features_doubled"),
        "features_forward_two_weeks": shown_features(feat.FORWARD_TWO_WEEKS, "features_two_weeks"),
        "features_forward_five_weeks": shown_features(feat.FORWARD_FIVE_WEEKS, "features_five_weeks"),
        "training_rows": shown_features(
            feat.NEXT_BANK_DAY, "(SELECT *, row_number() OVER (ORDER BY day DESC) AS n FROM features_next_day) WHERE n > 375"
        ),
        "feature_points": f"""
SELECT concat_ws(' ', '{two_weeks.training_measurement}', concat_ws(',', {', '.join(point(c, two_weeks) for c in two_weeks.columns)}),
       {nanos.format('day')}) AS value FROM features_two_weeks""",
        # financials
        "financial_quarters": "SELECT * FROM quarter_reports",
        "financial_years": f"""
SELECT c.ticker, CAST(p.y AS VARCHAR) || 'A' AS report_period, CAST(p.y AS INTEGER) AS fiscal_year, 'A' AS period, 'USD' AS currency,
       {items()}
FROM companies c CROSS JOIN range(1995, 2001) p(y) LEFT JOIN yearly t ON t.ticker = c.ticker AND t.y = p.y""",
        "new_report_periods": "SELECT ticker, report_period, revenue, eps_basic FROM quarter_reports WHERE fiscal_year >= 2000",
        # streaming
        "stream_trade_windows": f"SELECT {_trade_window_columns()} FROM {_closed('tw')}",
        "stream_quote_windows": f"SELECT {_quote_window_columns()} FROM {_closed('qw')}",
        **{
            f"stream_{name}_deltas": f"""
SELECT * EXCLUDE (measure_id) REPLACE (CAST(record_count_delta AS DOUBLE) AS record_count_delta)
FROM ({_deltas(f'(SELECT * FROM {_closed(source)})', metric_names, measurement)})"""
            for name, source, metric_names, measurement in (
                ("trade", "tw", TRADE_METRICS, TRADE_DELTAS),
                ("quote", "qw", QUOTE_METRICS, QUOTE_DELTAS),
            )
        },
    }
    out["asset_union"] = out["trade_windows"]
    out["shared_tags"] = """
SELECT trade_id, CASE WHEN lot_size > 50 THEN CAST(CAST(lot_size AS INTEGER) AS VARCHAR) ELSE '' END AS shared FROM trades"""
    out["ticker_aliases"] = """
SELECT c_custkey, 'F' || c_custkey % 1000 AS symbol, s_name AS ticker
FROM customer JOIN supplier ON s_suppkey = c_custkey % 1000 AND s_suppkey % 3 = 0"""
    out["polling_hours"] = f"""
SELECT dayofweek({local('ts')}) NOT IN (0, 6) AND hour({local('ts')}) BETWEEN 4 AND 21 AS polled, count(*) AS events
FROM events GROUP BY 1"""
    out["report_periods"] = """
SELECT DISTINCT day, year(day) || 'Q' || quarter(day) AS label, CAST(year(day) AS INTEGER) AS fiscal_year, 'Q' || quarter(day) AS period,
       (year(day) - 1) || 'A' AS latest_annual, year(day - INTERVAL 3 MONTH) || 'Q' || quarter(day - INTERVAL 3 MONTH) AS latest_quarter
FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)"""
    out["polled_rows"] = f"""
SELECT ts, {r('price_change_avg')} FROM index_regular
WHERE ts >= (SELECT max(ts) FROM index_regular WHERE ts < TIMESTAMP '2001-01-01')"""
    fitted = rs("growth", "regression_slope", "regression_intercept", "regression_variance")
    out["trend_segments"] = f"""
SELECT 'securities-daily-change-regular-hours' AS measurement, ticker, begins, ends, {fitted}, ends AS ts FROM member_segments"""
    for name, source in (("stream_trends", "streamed_segments"), ("stream_trends_redone", "redone_segments")):
        times = ", CAST(CASE WHEN ticker < 'NATION_2' THEN 1 ELSE 0 END AS BIGINT) AS redone" if source == "redone_segments" else ""
        out[name] = f"""
SELECT 'securities-daily-change-regular-hours' AS measurement, ticker, begins, ends, {fitted}, ends AS ts{times} FROM {source}"""
    out["trend_analysis"] = f"""
SELECT 'INDEX' AS ticker, ts, field, {r('value')} FROM (
  {_long('(SELECT ends AS ts, regression_variance, growth FROM index_segments)', {'regression_variance': 'avg(regression_variance)', 'growth': 'avg(growth)'})})"""
    out["stream_drawdown"] = out["drawdown"]
    newest = f"SELECT ticker, user_id, ts, event_id, {r('value')}, day FROM ({{0}}) WHERE n = 1"
    by_user = "row_number() OVER (PARTITION BY ticker, user_id ORDER BY ts DESC, event_id DESC) AS n"
    out["stored_upsert"] = newest.format(
        "SELECT *, row_number() OVER (PARTITION BY ticker, user_id, day ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS n FROM points"
    )
    out["stored_delete"] = newest.format(f"SELECT *, {by_user} FROM points") + " AND ticker <> 'view/USD#1' AND value <= 300"
    out["stored_rename"] = newest.format(
        f"SELECT *, {by_user} FROM (SELECT * REPLACE (CASE ticker WHEN 'view/USD#1' THEN 'click/USD#1' ELSE ticker END AS ticker) FROM points)"
    )
    out["stored_documents"] = """
SELECT 'f#' || o_custkey AS pk, o_orderstatus AS sk, CAST(max(o_orderkey) AS VARCHAR) AS body, max(o_orderkey) AS version
FROM orders GROUP BY ALL"""
    for name, limit in (("index_refresh", "9999-01-01"), ("index_redo", "2000-01-01")):
        out[name] = f"""
SELECT ticker, day, {r('price_change_avg')}, strftime(day, '%Y-%m') AS month FROM (
  SELECT ticker, day, price_change_avg FROM members_regular UNION ALL SELECT 'INDEX', day, price_change_avg FROM index_regular)
WHERE day < DATE '{limit}'"""
    out["member_versions"] = f"""
SELECT ticker, min(introduction_day) AS introduction_day, {r('any_value(introduction_price)', 'introduction_price')},
       {r('any_value(index_value_when_introduced)', 'index_value_when_introduced')}, max(day) AS prev_day,
       {r('arg_max(avg_price, day)', 'prev_avg_price')}, as_of
FROM members_regular JOIN (SELECT make_date(CAST(y AS INTEGER), 1, 1) AS as_of FROM range(1980, 2100) t(y)) ON day < as_of
WHERE as_of <= (SELECT max(day) + INTERVAL 1 MONTH FROM members_regular) GROUP BY ticker, as_of"""
    out["statement_lookup"] = "SELECT * FROM quarter_reports WHERE ticker = 'BUILDING' AND report_period = '1998Q2'"
    out["renamed_fields"] = " UNION ALL ".join(
        f"SELECT ticker, window_end_time, '{name}' AS _field, {r(c, '_value')} FROM tw"
        for c, name in (("volume_weighted_avg_price", "vwap_price"), ("sum_notional", "trade_notional"), ("max_price", "max_price"))
    )
    out["bank_day_range"] = f"""
SELECT day FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS day FROM orders)
WHERE {bank_day('day')}"""
    out["index_level_anchored"] = f"""
SELECT ts, value FROM ({out['index_level'].strip()})
UNION ALL SELECT TIMESTAMP '2002-01-01', x FROM (VALUES (CAST(0.0 AS DOUBLE)), (CAST(2.5 AS DOUBLE))) t(x)"""
    out["epochs"] = "SELECT event_id, CAST(CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS DOUBLE) AS millis FROM events"
    out["stale_mark"] = """
SELECT CAST(least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS DATE) AS stale_from"""
    out["nearest_points"] = f"""
SELECT a.ticker, a.ts, a.trade_id, CASE WHEN d <= 18000 THEN p.ts END AS nearest_ts, CASE WHEN d <= 18000 THEN record_count END AS record_count,
       {r('CASE WHEN d <= 18000 THEN sum_notional END', 'sum_notional')}, {r('CASE WHEN d <= 18000 THEN d END', 'distance')}
FROM (SELECT symbol AS ticker, market_ts AS ts, trade_id FROM trades) a
LEFT JOIN (SELECT ticker, window_end_time AS ts, record_count, sum_notional FROM tw WHERE record_count > 15) p ON p.ticker = a.ticker
CROSS JOIN LATERAL (SELECT abs(epoch_us(p.ts) - epoch_us(a.ts)) / 1000000.0 AS d)
QUALIFY row_number() OVER (PARTITION BY a.trade_id ORDER BY d, p.ts) = 1"""
    out["polylines"] = f"""
SELECT ticker, CAST((n - 1) // 50 AS BIGINT) AS piece, string_agg(printf('%.2f,%.2f', x, y), ' ' ORDER BY n) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY x, y) AS n FROM ({out['chart_points']})) GROUP BY 1, 2"""
    start = "CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '1990-01-01' END"
    out["paged_bars"] = f"""
SELECT ticker, market_ts, CAST(volume AS BIGINT) AS volume, {r('high_price', 'opening_price')}, {r('low_price', 'closing_price')},
       {rs('high_price', 'low_price')}, {r('vwap', 'volume_weighted_avg_price')}
FROM bars JOIN nation ON n_name = ticker WHERE market_ts >= greatest({start}, TIMESTAMP '1995-01-01')"""
    out["tickers_without_pages"] = f"""
SELECT n_name AS ticker, {start} AS start FROM nation WHERE n_name NOT IN (SELECT ticker FROM bars)
UNION ALL SELECT 'GONE', max({start}) FROM nation"""
    out["series_scan"] = f"""
SELECT 'index-daily-change-regular-hours' AS measurement, ts, {rs('price_change_avg', 'total_trading_value')}
FROM index_regular WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'"""
    out["document_lookup"] = """
SELECT 'f#' || o_custkey AS pk, o_orderstatus AS sk, CAST(max(o_orderkey) AS VARCHAR) AS body, max(o_orderkey) AS version
FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) OR (o_custkey = (SELECT max(o_custkey) FROM orders) AND o_orderstatus = 'F') GROUP BY ALL"""
    out["training_export"] = f"""
SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c.startswith('days_since') else c for c in feat.NEXT_BANK_DAY.columns)} FROM ({out['training_rows']})"""
    out["universe_table"] = """
SELECT n_name AS ticker, n_name || ' Inc' AS company, CAST(NULL AS VARCHAR) AS series, DATE '1990-01-01' AS start_date, CAST(NULL AS DATE) AS end_date,
       CAST(NULL AS VARCHAR) AS fundamentals_ticker, n_nationkey % 5 = 0 AS skip FROM nation"""
    out["sampled_companies"] = "SELECT least(count(*), 10) AS companies, false AS skip FROM nation WHERE n_nationkey % 5 <> 0"
    out["session_feed"] = f"""
SELECT symbol, trade_id, market_ts, {rs('price', 'lot_size')} FROM trades
WHERE market_ts >= (SELECT {utc("CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) + INTERVAL '8:30:00'")} FROM events)"""
    out["statement_responses"] = """
SELECT ticker, ticker < 'C' AS annual, ticker BETWEEN 'B' AND 'G' AS quarterly FROM companies WHERE ticker < 'C' OR ticker BETWEEN 'B' AND 'G'"""
    out["least_instants"] = """
SELECT event_id, least(CASE WHEN event_id % 2 <> 0 THEN ts + INTERVAL 5 HOUR END, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 3 HOUR END,
  CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 4 HOUR END) AS earliest FROM events"""
    out["checked_features"] = f"SELECT count(*) AS rows, {r('max(vix)', 'vix')}, 3 AS refused FROM features_two_weeks"
    first_day = "(SELECT CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) FROM events)"
    out["quotations_of_a_day"] = f"""
{out['windowed_quotations'].strip()} WHERE ticker = 'purchase' AND window_end_time >= {first_day} + INTERVAL 9 DAY AND window_end_time < {first_day} + INTERVAL 10 DAY"""
    newest = "(SELECT max(window_end_time) + INTERVAL 30 MINUTE FROM qw)"
    out["quotations_of_the_last_hour"] = f"""
{out['windowed_quotations'].strip()} WHERE window_end_time >= {newest} - INTERVAL 1 HOUR AND window_end_time < {newest}"""
    out["member_trends_included"] = out["member_trends"] + " AND ticker IN ('NATION_1', 'NATION_2')"
    out["member_attribution_bull"] = attribution("idx > 0.2")
    out["member_attribution_bear"] = attribution("idx < -0.2 AND ticker IN ('NATION_3', 'NATION_4')")
    out["replayed_windows"] = f"SELECT *, 1 AS deliveries FROM ({out['stream_trade_windows']})"
    out["replayed_throughput"] = out["throughput"]
    out["live_assets"] = out["stream_trade_windows"]
    last = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY window_end_time DESC) = 1"
    out["stream_state_windows"] = f"""
SELECT ticker, window_end_time, CAST(record_count AS DOUBLE) AS record_count, {rs(*[m for m in TRADE_METRICS if m != 'record_count'])} FROM {_closed('tw')} {last}"""
    out["stream_state_maxima"] = f"""
SELECT ticker, max(ts) AS ts, {', '.join(r(f'max(price_change_{f})', f) for f in ('low', 'avg', 'high'))} FROM members_regular GROUP BY ticker"""
    out["late_trades"] = """
SELECT count(*) AS rows, max(ts) AS newest, count(*) FILTER (ends <= before - INTERVAL 120 SECOND) AS late
FROM (SELECT a.*, (SELECT date_trunc('milliseconds', max(b.ts)) FROM arrivals b WHERE b.step < a.step) AS before FROM arrivals a) GROUP BY step"""
    out["counted_batches"] = """
SELECT symbol, CAST((n - 1) // 100 + 1 AS BIGINT) AS batch, count(*) AS trades, min(market_ts) AS first, max(market_ts) AS last, CAST(sum(trade_id) AS BIGINT) AS ids
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY market_ts, trade_id) AS n FROM trades) GROUP BY 1, 2"""
    out["logged_windows"] = f"""
SELECT {_trade_window_columns()} FROM logged_tw WHERE window_end_time <= (SELECT max(market_ts) - INTERVAL 120 SECOND FROM logged_trades)"""
    out["pushed_batches"] = f"""
SELECT delivery, symbol, batch, any_value(ids) AS ids, count(*) AS connections
FROM (SELECT delivery, symbol, (n - 1) // 7 AS batch, string_agg(measure_id, ',' ORDER BY n) AS ids
      FROM (SELECT *, row_number() OVER (PARTITION BY delivery, symbol ORDER BY window_end_time, measure_id) AS n
            FROM (SELECT ticker AS symbol, measure_id, window_end_time, {_step('window_end_time', 'tw')} AS delivery FROM tw WHERE record_count % 11 <> 0)) GROUP BY 1, 2, 3)
JOIN customer ON symbol = list_extract(['click', 'error', 'purchase', 'signup', 'view'], c_custkey % 5 + 1)
 AND c_custkey % 4 <= delivery AND (c_custkey % 7 <> 0 OR delivery < 2)
GROUP BY 1, 2, 3"""
    found = {name: assemble(body) for name, body in out.items()}
    found["microstructure_stepped"] = found["microstructure_stepped"].replace("INTERVAL '6 hours'", "INTERVAL '1 minute'").replace("INTERVAL 6 HOUR", "INTERVAL 1 MINUTE")
    return found


def _step(ts: str, source: str) -> str:
    """In which of four even parts of the time between a table's first and last row a time lies; the last time of a part is in it."""
    ends = f"(SELECT min(epoch_us({ts})) AS a, max(epoch_us({ts})) AS b FROM {source})"
    return "CAST(" + " + ".join(f"CAST(epoch_us({ts}) > (SELECT a + (b - a) * {i} // 4 FROM {ends}) AS INTEGER)" for i in (1, 2, 3)) + " AS BIGINT)"


PARTS["delayed"] = """
SELECT market_ts AS ts, CASE WHEN trade_id % 13 = 0 THEN market_ts + INTERVAL 2 DAY ELSE market_ts END AS arrived FROM trades"""
PARTS["arrivals"] = f"""
SELECT ts, {bucket('6 hours', 'ts')} + INTERVAL 6 HOUR AS ends, {_step('arrived', 'delayed')} AS step FROM delayed"""
PARTS["logged_trades"] = """
SELECT event_type AS symbol, event_id AS trade_id, ts AS market_ts, value AS price, k AS lot_size
FROM feed WHERE route = 'stock_trade' AND k NOT IN (7, 11, 13)"""
PARTS["logged_tw0"] = PARTS["tw0"].replace("FROM trades", "FROM logged_trades")
PARTS["logged_tw"] = PARTS["tw"].replace("FROM tw0", "FROM logged_tw0")


def _slope(begin: str, end: str) -> str:
    """Slope of the percent change over rows begin..end-1, from running sums s and moments q (both from row 0)."""
    moment = f"(q[{end} + 1] - q[{begin} + 1] - ({begin} + {end} - 1) / 2.0 * (s[{end} + 1] - s[{begin} + 1]))"
    return f"(100.0 / v[{begin} + 1] * {moment} * 12.0 / (({end} - {begin}) * (pow({end} - {begin}, 2) - 1)))"


def _cut(b: str, e1: str) -> str:
    return f"CAST(coalesce(list_max(list_filter(range(7), lambda j: abs(v[{e1} - 7 + j + 1] - v[{b} + j + 1]) <= 0.05)), 0) AS BIGINT)"


def _cuts(b: str, e1: str) -> str:
    return f"{e1} - {b} >= 14 AND abs({_slope(b, e1)} - {_slope(f'({e1} - 7)', e1)}) > 0.8"


def _fitted(name: str) -> None:
    """Segments from the rows of a walk that have found one."""
    PARTS[name] = f"""
SELECT f.ticker, f.begins, f.ends, f.slope * date_diff('day', f.begins, f.ends) AS growth, f.slope AS regression_slope,
       f.intercept AS regression_intercept, f.variance AS regression_variance
FROM (SELECT w.ticker, min(r.ts) AS begins, max(CASE WHEN r.i = w.last THEN r.ts END) AS ends, regr_slope(y, r.i - w.head) AS slope,
             regr_intercept(y, r.i - w.head) AS intercept,
             (regr_syy(y, r.i - w.head) - pow(regr_slope(y, r.i - w.head), 2) * regr_sxx(y, r.i - w.head)) / count(*) AS variance
      FROM {name}_walk w JOIN (SELECT ticker, ts, i, x FROM {name}_rows) r ON r.ticker = w.ticker AND r.i >= w.head AND r.i < w.stop
      JOIN {name}_rows h ON h.ticker = w.ticker AND h.i = w.head CROSS JOIN LATERAL (SELECT (r.x / h.x - 1) * 100 AS y)
      WHERE w.head IS NOT NULL GROUP BY w.ticker, w.head, w.last, w.stop) f"""


def segments(name: str, source: str) -> None:
    """Trend windows of ``source(ticker, ts, price_change_avg)``: smallest window 7, slope change 0.8, tolerance 0.05."""
    PARTS[f"{name}_rows"] = f"""
SELECT ticker, ts, price_change_avg AS x, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i FROM {source}"""
    PARTS[f"{name}_sums"] = f"""
SELECT ticker, ts, x, i, sum(x) OVER w AS s, sum(x * i) OVER w AS q FROM {name}_rows WINDOW w AS (PARTITION BY ticker ORDER BY i)"""
    PARTS[f"{name}_lists"] = f"""
SELECT ticker, list(x ORDER BY i) AS v, list_prepend(0.0, list(s ORDER BY i)) AS s, list_prepend(0.0, list(q ORDER BY i)) AS q
FROM {name}_sums GROUP BY ticker"""
    PARTS[f"{name}_walk"] = f"""
SELECT ticker, CAST(0 AS BIGINT) AS b, CAST(14 AS BIGINT) AS e, CAST(NULL AS BIGINT) AS head, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS stop
FROM {name}_lists
UNION ALL
SELECT ticker, CASE WHEN cuts THEN e1 - 7 + c ELSE b END, CASE WHEN cuts THEN e1 + c ELSE e1 END,
       CASE WHEN cuts THEN b END, CASE WHEN cuts THEN e1 - 7 + c END, CASE WHEN cuts THEN e1 END
FROM (SELECT ticker, b, e1, {_cut('b', 'e1')} AS c, {_cuts('b', 'e1')} AS cuts
      FROM (SELECT w.ticker, w.b, w.e + 1 AS e1, l.v, l.s, l.q FROM {name}_walk w JOIN {name}_lists l ON l.ticker = w.ticker WHERE len(l.v) - w.e >= 14))"""
    _fitted(name)


def streamed_segments(name: str, source: str, redone: str = "false") -> None:
    """Trend windows as a stream of four even steps of time finds them: each step starts with the rows that are undecided, and
    windows are cut with the rows so far. Undecided rows more than a week older than the step's first are left out. Tickers that
    are ``redone`` start afresh in the third step."""
    PARTS[f"{name}_rows"] = f"""
SELECT ticker, ts, price_change_avg AS x, row_number() OVER w - 1 AS i, {_step('ts', source)} AS step,
       ts - lag(ts) OVER w > INTERVAL 7 DAY AS apart, lag({_step('ts', source)}) OVER w AS before
FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY ts)"""
    PARTS[f"{name}_sums"] = f"""
SELECT *, sum(x) OVER w AS s, sum(x * i) OVER w AS q FROM {name}_rows WINDOW w AS (PARTITION BY ticker ORDER BY i)"""
    PARTS[f"{name}_lists"] = f"""
SELECT ticker, list(x ORDER BY i) AS v, list_prepend(0.0, list(s ORDER BY i)) AS s, list_prepend(0.0, list(q ORDER BY i)) AS q,
       [{', '.join(f'count(*) FILTER (step <= {k})' for k in range(4))}] AS n,
       [{', '.join(f'coalesce(bool_or(step = {k} AND before <> {k} AND apart), false)' for k in range(4))}] AS breaks
FROM {name}_sums GROUP BY ticker"""
    PARTS[f"{name}_walk"] = f"""
SELECT ticker, CASE WHEN {redone} THEN 2 ELSE 0 END AS k, CAST(0 AS BIGINT) AS b, CAST(14 AS BIGINT) AS e,
       CAST(NULL AS BIGINT) AS head, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS stop
FROM {name}_lists
UNION ALL
SELECT ticker, CASE WHEN grows THEN k ELSE k + 1 END,
       CASE WHEN cuts THEN e1 - 7 + c WHEN NOT grows AND breaks[k + 2] THEN n[k + 1] ELSE b END,
       CASE WHEN cuts THEN e1 + c WHEN grows THEN e1 WHEN breaks[k + 2] THEN n[k + 1] + 14 ELSE b + 14 END,
       CASE WHEN cuts THEN b END, CASE WHEN cuts THEN e1 - 7 + c END, CASE WHEN cuts THEN e1 END
FROM (SELECT ticker, k, b, e1, n, breaks, grows, CASE WHEN grows THEN {_cut('b', 'e1')} END AS c, CASE WHEN grows THEN {_cuts('b', 'e1')} ELSE false END AS cuts
      FROM (SELECT w.ticker, w.k, w.b, w.e + 1 AS e1, l.v, l.s, l.q, l.n, l.breaks, l.n[w.k + 1] - w.e >= 14 AS grows
            FROM {name}_walk w JOIN {name}_lists l ON l.ticker = w.ticker WHERE w.k < 3 OR l.n[4] - w.e >= 14))"""
    _fitted(name)


segments("member_segments", "members_regular")
segments("index_segments", "(SELECT 'INDEX' AS ticker, ts, price_change_avg FROM index_regular)")

streamed_segments("streamed_segments", "members_regular")
streamed_segments("redone_segments", "members_regular", "ticker < 'NATION_2'")

PARTS["points"] = """
SELECT event_type || '/USD#1' AS ticker, user_id, ts, event_id, value, CAST(ts AS DATE) AS day FROM events"""

PARTS["numbered"] = """
SELECT ticker, year(day) AS year, day, price_change_avg, row_number() OVER w - 1 AS position,
       count(*) OVER (PARTITION BY ticker, year(day)) AS n
FROM members_regular WINDOW w AS (PARTITION BY ticker, year(day) ORDER BY day)"""

_NAME = re.compile(r"\b(" + "|".join(sorted(PARTS, key=len, reverse=True)) + r")\b")


def assemble(body: str) -> str:
    """Put the parts a statement needs in front of it, each after those it refers to."""
    ordered: list[str] = []

    def need(text: str, parent: str | None = None) -> None:
        for name in _NAME.findall(re.sub(r"'[^']*'", "''", text)):
            if name != parent and name not in ordered:
                need(PARTS[name], name)
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({PARTS[name].strip()})" for name in ordered)
    return f"WITH RECURSIVE {parts}\n{body.strip()}"
