"""Several live inputs in one query, idle ones, and what each micro-batch brought.

Each input has a watermark of its own and the least of them counts, so that a slow input loses nothing. An
input that brings no rows for a while would hold all windows open; it is sent a *beat*, a row
without content at the time the others have reached, which moves its watermark and goes no further.
A restarted query knows the common watermark alone: it moves on once each input has brought a row or a beat.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tickwise.streaming.live import IDLE, LATENESS

#: A policy under which the least watermark counts, whatever the session says.
POLICY = "spark.sql.streaming.multipleWatermarkPolicy"
BEAT = "_beat"


def seconds(duration: str) -> float:
    number, unit = duration.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def instant(micros: int) -> datetime:
    """A time in microseconds as a time in UTC."""
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros)


def beat_folder(folder: str, name: str) -> str:
    return f"{folder}/beats/{name}"


def send_beat(spark: SparkSession, folder: str, name: str, at: datetime, ts: str = "market_ts") -> None:
    """A beat for an input; ``at`` is in UTC."""
    rows = spark.createDataFrame([(at.isoformat(),)], "at string").select(F.col("at").cast("timestamp").alias(ts))
    rows.coalesce(1).write.mode("append").parquet(beat_folder(folder, name))


def live_input(events: DataFrame, name: str, folder: str, lateness: str = LATENESS, ts: str = "market_ts") -> DataFrame:
    """An input's events behind a watermark that its beats move, too; its rows are counted in each batch's progress.

    ``folder`` keeps the beats and is part of the query's state: a restarted query needs the same one.
    """
    spark = events.sparkSession
    path = beat_folder(folder, name)
    spark.createDataFrame([], f"`{ts}` timestamp").write.mode("append").parquet(path)
    beats = spark.readStream.schema(f"`{ts}` timestamp").parquet(path)
    counted = events.observe(f"input_{name}", F.count(F.lit(1)).alias("rows"), F.max(F.unix_micros(ts)).alias("newest"))
    both = counted.withColumn(BEAT, F.lit(False)).unionByName(beats.withColumn(BEAT, F.lit(True)), allowMissingColumns=True)
    marked = both.withWatermark(ts, lateness)
    # the condition names the event time (by a time that no row has), else it would be moved in front of the watermark
    never = F.unix_micros(ts) == F.lit(-(1 << 63))
    return marked.filter(~F.col(BEAT) | never).drop(BEAT)


class IdleWatch:
    """Decides which inputs get a beat, from the progress of each micro-batch.

    An input is idle if it has brought no rows for ``patience`` while another did. Its beat is at
    the newest time of the inputs that go on, and no second one is sent until that time has moved.
    """

    def __init__(self, names: list[str], patience: str = IDLE):
        self.patience = seconds(patience)
        self.last_rows: dict[str, float] = {}
        self.newest: dict[str, int] = {}
        self.names, self.sent = names, dict.fromkeys(names, 0)

    def look(self, rows: dict[str, tuple[int, int | None]], now: float) -> dict[str, int]:
        """``rows``: count and newest time (microseconds) of each input's rows; returns the beats due, by name."""
        for name in self.names:
            count, newest = rows.get(name, (0, None))
            self.last_rows.setdefault(name, now)
            if count:
                self.last_rows[name] = now
                self.newest[name] = max(newest or 0, self.newest.get(name, 0))
        active = [n for n in self.names if now - self.last_rows[n] < self.patience and n in self.newest]
        if not active:
            return {}
        reached = max(self.newest[n] for n in active)
        due = [n for n in self.names if n not in active and max(self.sent[n], self.newest.get(n, 0)) < reached]
        self.sent |= dict.fromkeys(due, reached)
        return dict.fromkeys(due, reached)


class ProgressLog(StreamingQueryListener):
    """What each micro-batch of a query brought, as rows; ``beats`` is called with the beats due after it."""

    def __init__(self, watch: IdleWatch | None = None, beats: Callable[[str, datetime], None] | None = None):
        self.rows: list[dict] = []
        self.watch, self.beats = watch, beats
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        self.rows.append(batch_row(progress))
        if self.watch is not None and self.beats is not None:
            seen = {k.removeprefix("input_"): (v["rows"], v["newest"]) for k, v in progress.get("observedMetrics", {}).items() if k.startswith("input_")}
            at = datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp()
            for name, micros in self.watch.look(seen, at).items():
                self.beats(name, instant(micros))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def run(self, spark: SparkSession, drain: Callable[[], None]) -> None:
        """Listens while ``drain`` runs a query to its end."""
        spark.streams.addListener(self)
        try:
            drain()
            self.ended.wait(60)
        finally:
            spark.streams.removeListener(self)

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch, rows, newest, late, watermark): one row a micro-batch, a few numbers each."""
        rows = [(r["query"], r["batch"], r["rows"], r["newest"], r["late"], r["watermark"]) for r in self.rows]
        return spark.createDataFrame(rows, "query string, batch long, rows long, newest long, late long, watermark string").select(
            "query", "batch", "rows", F.timestamp_micros("newest").alias("newest"), "late", F.col("watermark").cast("timestamp").alias("watermark")
        )


def batch_row(progress: dict) -> dict:
    """A micro-batch's rows, newest event time and late rows, from its progress.

    Late rows are those the first stateful operator has left out: behind it others see aggregates.
    """
    metrics = [v for k, v in progress.get("observedMetrics", {}).items() if k.startswith("input_")]
    newest = [m["newest"] for m in metrics if m["newest"] is not None]
    operators = progress.get("stateOperators", [])
    return {
        "query": progress["id"],
        "batch": progress["batchId"],
        "rows": sum(m["rows"] for m in metrics),
        "newest": max(newest, default=None),
        "late": max((o["numRowsDroppedByWatermark"] for o in operators if o["operatorName"] == "dedupe"), default=0),
        "watermark": progress.get("eventTime", {}).get("watermark"),
    }


def distinct_in_window(events: DataFrame, keys: list[str], every: str, ts: str = "market_ts") -> DataFrame:
    """Events delivered twice count once while their window, ``w``, is open; rows of closed windows are left out and counted as late.

    From here on the window is the event time, so aggregates group by it.
    """
    plain = [F.col(c).alias(c, metadata={}) if c == ts else F.col(c) for c in events.columns]
    return events.withColumn("w", F.window(ts, every)).select(*plain, "w").dropDuplicates([*keys, "w"])
