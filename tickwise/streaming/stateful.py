"""Keyed state: previous window, running maximum, undecided trend tail, batching.

Each processor handles the rows of one key inside one micro-batch.  The inputs are
aggregated rows (one per window or day), so a key's share of a micro-batch is bounded
by the time it spans.  Needs the RocksDB state store (``live.use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickwise.operators.drawdown import FIELDS
from tickwise.operators.trends import SEGMENT_FIELDS, SERIES, TrendRules, find_segments, segment_rows

DAY_MS = 86_400_000
WEEK = pd.Timedelta(days=7)
STATE_TTL_MS = DAY_MS


def _gather(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class PreviousWindow(StatefulProcessor):
    """Emit each metric minus its value in the previous window of the key.

    The first window only sets the state; windows not later than the previous one
    are dropped.
    """

    def __init__(self, metrics: list[str], schema: str, ttl_ms: int | None = None):
        self.metrics, self.schema, self.ttl_ms = metrics, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.previous = handle.getValueState("previous", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _gather(rows).sort_values("window_end_time", ignore_index=True)
        stored = self.previous.get() if self.previous.exists() else None
        if stored is not None:
            batch = batch[batch["window_end_time"] > pd.Timestamp(stored[0])]
        batch = batch.drop_duplicates("window_end_time")
        if batch.empty:
            return
        values = batch[self.metrics].astype(float)
        before = values.shift(1)
        if stored is not None:
            before.iloc[0] = stored[1:]
        last = batch.iloc[-1]
        self.previous.update((last["window_end_time"].to_pydatetime(), *[float(last[m]) for m in self.metrics]))
        deltas = (values - before).add_suffix("_delta")
        deltas.insert(0, "timestamp", batch["window_end_time"])
        deltas.insert(0, "ticker", key[0])
        yield deltas if stored is not None else deltas.iloc[1:]

    def close(self) -> None:
        pass


def stream_deltas(windows: DataFrame, metrics: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Window-to-window deltas with the previous window in state.

    ``ttl_ms`` (24 h in live use) expires the state; it needs processing time, which
    keeps a query scheduling, so it is off unless asked for.
    """
    state = "window_end_time timestamp, " + ", ".join(f"`{m}` double" for m in metrics)
    output = "ticker string, timestamp timestamp, " + ", ".join(f"`{m}_delta` double" for m in metrics)
    return windows.select("ticker", "window_end_time", *metrics).groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=PreviousWindow(metrics, state, ttl_ms),
        outputStructType=output,
        outputMode="append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


class RunningMaximum(StatefulProcessor):
    """Drawdown levels against the highest values seen so far.

    Rows not later than the stored time are dropped; rows of today are emitted
    without raising the maximum; a row at or before the earliest date starts afresh.
    """

    def __init__(self, keys: list[str], earliest: str | None, as_of: str | None):
        self.keys, self.earliest, self.as_of = keys, earliest, as_of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "ts timestamp, " + ", ".join(f"{f} double" for f in FIELDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _gather(rows).sort_values("ts", ignore_index=True).drop_duplicates("ts")
        if self.earliest and (batch["ts"] <= pd.Timestamp(self.earliest)).any():
            self.top.clear()
        stored = self.top.get() if self.top.exists() else None
        start = np.zeros(len(FIELDS))
        if stored is not None:
            batch, start = batch[batch["ts"] > pd.Timestamp(stored[0])], np.array(stored[1:], dtype=float)
        if batch.empty:
            return
        final = np.ones(len(batch), dtype=bool) if not self.as_of else (batch["ts"] < pd.Timestamp(self.as_of)).to_numpy()
        values = batch[[f"price_change_{f}" for f in FIELDS]].to_numpy(dtype=float)
        counted = np.where(final[:, None], values, -np.inf)
        running = np.maximum.accumulate(np.vstack([start, counted]), axis=0)
        if final.any():
            last = batch.loc[final, "ts"].iloc[-1].to_pydatetime()
            self.top.update((last, *running[-1].tolist()))
        tops = np.maximum(running[:-1], values)
        levels = np.divide(values, tops, out=np.full_like(values, np.nan), where=tops > 0) * 100
        out = batch[["ts", *[f"price_change_{f}" for f in FIELDS]]].copy()
        for i, name in enumerate(FIELDS):
            out[f"drawdown_{name}"] = levels[:, i]
        for i, name in enumerate(self.keys):
            out.insert(i, name, key[i])
        yield out

    def close(self) -> None:
        pass


def stream_drawdown(index: DataFrame, keys: Sequence[str] = SERIES, earliest: str | None = None, as_of: str | None = None) -> DataFrame:
    """Drawdown of a stream of daily rows."""
    columns = [f"price_change_{f}" for f in FIELDS]
    output = ", ".join(f"`{k}` string" for k in keys) + ", ts timestamp, " + ", ".join(
        f"{c} double" for c in [*columns, *[f"drawdown_{f}" for f in FIELDS]]
    )
    return index.select(*keys, "ts", *columns).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=RunningMaximum(keys, earliest, as_of),
        outputStructType=output,
        outputMode="append",
        timeMode="None",
    )


class UndecidedTail(StatefulProcessor):
    """Trend segments of a growing series; the undecided rows wait in state.

    A tail whose last row is more than a week older than the new rows is left out,
    and a row at or before the earliest date starts afresh. So does a control row, which
    says so and has no time; it goes before the other rows of its micro-batch. Segments carry how
    often their series has been redone so far, which the state keeps.
    """

    def __init__(self, keys: list[str], earliest: str | None, rules: TrendRules):
        self.keys, self.earliest, self.rules = keys, earliest, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "ts timestamp, value double")
        self.redone = handle.getValueState("redone", "times long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _gather(rows)
        times = self.redone.get()[0] if self.redone.exists() else 0
        if batch["redo"].any():
            times += 1
            self.redone.update((times,))
            self.tail.clear()
        batch = batch.loc[~batch["redo"], ["ts", "value"]].sort_values("ts")
        if batch.empty:
            return
        if self.earliest and batch["ts"].iloc[0] <= pd.Timestamp(self.earliest):
            self.tail.clear()
        waiting = pd.DataFrame(list(self.tail.get()) if self.tail.exists() else [], columns=["ts", "value"])
        if len(waiting):
            waiting["ts"] = pd.to_datetime(waiting["ts"]).astype(batch["ts"].dtype)
            if batch["ts"].iloc[0] - waiting["ts"].max() <= WEEK:
                batch = pd.concat([waiting, batch])
        batch = batch.drop_duplicates("ts").sort_values("ts", ignore_index=True)
        segments, begin = find_segments(batch["value"].to_numpy(dtype=float), self.rules)
        rest = batch.iloc[begin:]
        self.tail.put([(t.to_pydatetime(), float(v)) for t, v in zip(rest["ts"], rest["value"])])
        out = segment_rows(batch["ts"], segments)
        for i, name in enumerate(self.keys):
            out.insert(i, name, key[i])
        out["redone"] = times
        yield out

    def close(self) -> None:
        pass


def stream_trends(index: DataFrame, value: str = "price_change_avg", keys: Sequence[str] = SERIES, earliest: str | None = None, rules: TrendRules = TrendRules(), redo: str | None = None) -> DataFrame:
    """Confirmed trend segments of a stream of daily rows.

    ``redo`` names a boolean column that is true in control rows, which make their series start afresh. Segments of
    a series that are ``redone`` less often than its state says have been replaced by later ones.
    """
    output = ", ".join(f"`{k}` string" for k in keys) + ", " + SEGMENT_FIELDS + ", redone long"
    control = F.coalesce(F.col(redo), F.lit(False)) if redo else F.lit(False)
    return index.select(*keys, "ts", F.col(value).alias("value"), control.alias("redo")).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=UndecidedTail(keys, earliest, rules),
        outputStructType=output,
        outputMode="append",
        timeMode="None",
    )


class CountOrTimer(StatefulProcessor):
    """Release waiting rows as a numbered batch once enough have come, or after a while.

    A key has one timer at most. It is due ``wait_ms`` after the last release or, if that
    has passed already, after the first row that waits. A release by count deletes it and sets it anew for
    the rows that are left, so these don't leave by the time of rows that have gone.
    """

    def __init__(self, columns: list[str], order: list[str], schema: str, count: int, wait_ms: int, ts: str | None):
        self.columns, self.order, self.schema, self.count, self.wait_ms, self.ts = columns, order, schema, count, wait_ms, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.released = handle.getValueState("released", "batch long, at long")

    def _release(self, key, rows: list[tuple], at: int) -> pd.DataFrame:
        number = (self.released.get()[0] if self.released.exists() else 0) + 1
        self.released.update((number, at))
        out = pd.DataFrame(rows, columns=self.columns)
        out.insert(0, "batch", number)
        out.insert(0, "key", key[0])
        return out

    def _set_timer(self, now: int | None) -> None:
        """The only timer is set for rows that wait since ``now``; None: there are none."""
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if now is not None:
            last = self.released.get()[1] if self.released.exists() else None
            due = now + self.wait_ms if last is None or last + self.wait_ms <= now else last + self.wait_ms
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        batch = _gather(rows)
        batch = batch.sort_values(self.order, ignore_index=True) if self.order else batch
        if self.ts:
            now = int(pd.Timestamp(batch[self.ts].max()).timestamp() * 1000)
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
        first = not waiting
        waiting.extend(batch[self.columns].itertuples(index=False, name=None))
        full = len(waiting) // self.count * self.count
        for i in range(0, full, self.count):
            yield self._release(key, waiting[i : i + self.count], now)
        if full < len(waiting):
            self.waiting.put(waiting[full:])
        else:
            self.waiting.clear()
        if self.wait_ms and (full or first):
            self._set_timer(now if full < len(waiting) else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if waiting:
            self.waiting.clear()
            yield self._release(key, waiting, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def count_or_timer(
    rows: DataFrame, key: str, columns: dict[str, str], count: int = 100, wait_ms: int = 30_000, order: Sequence[str] = (), ts: str | None = None
) -> DataFrame:
    """Rows of each key in batches of ``count``; a smaller batch leaves after ``wait_ms`` (0: never).

    Rows of a micro-batch are taken in ``order``. With ``ts``, one of ``columns`` behind a watermark, the time is that of
    the events, and a row's release doesn't depend on when it is processed.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    return rows.select(F.col(key).cast("string").alias("key"), *columns).groupBy("key").transformWithStateInPandas(
        statefulProcessor=CountOrTimer(list(columns), list(order), schema, count, wait_ms, ts),
        outputStructType=f"key string, batch long, {schema}",
        outputMode="append",
        timeMode="None" if not wait_ms else "EventTime" if ts else "ProcessingTime",
    )
