"""Event feeds: debouncing, sliding-window admission and request figures, for batches and for streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def bursts(events: DataFrame, by: str, gap_seconds: int) -> DataFrame:
    """by, start, stop, n: runs of events with less than gap_seconds between them; one firing for each."""
    order = Window.partitionBy(by).orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)) >= gap_seconds * 1_000_000, F.lit(True))
    marked = events.withColumn("new", new.cast("int")).withColumn("burst", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "burst").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).drop("burst")


def stream_bursts(events: DataFrame, by: str, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: a session window that fires when it closes; rows later than `late` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(by, F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).drop("w")


def in_order(events: DataFrame, by: str) -> DataFrame:
    """by, event_id and t (microseconds), each key's rows in one task and in the order of time and id."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    return events.select(by, "event_id", t).repartition(by).sortWithinPartitions(by, "t", "event_id")


def admitted(events: DataFrame, by: str, window_seconds: int, most: int) -> DataFrame:
    """by, event_id, ok: whether fewer than `most` admitted events lie in the window before (its far edge counts).

    Admission depends on earlier admissions, so each key's rows stream by in order; of them only the admitted times that
    the window still holds are kept, `most` at most. Rows without a time are admitted never.
    """
    kind = events.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = object(), deque()
        for batch in batches:
            ok = []
            for now, t in zip(batch.column(0).to_pylist(), batch.column("t").to_pylist(), strict=True):
                if now != key:
                    key, held = now, deque()
                ok.append(admits(held, t, window_seconds, most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("event_id"), pa.array(ok, pa.bool_())], [by, "event_id", "ok"])

    return in_order(events, by).mapInArrow(run, f"`{by}` {kind}, event_id {events.schema['event_id'].dataType.simpleString()}, ok boolean")


def admits(held: deque[int], t: int | None, window_seconds: int, most: int) -> bool:
    """Whether an event at t (microseconds) is admitted after those at the times held, which change with it."""
    if t is None:
        return False
    while held and t - held[0] > window_seconds * 1_000_000:
        held.popleft()
    if len(held) >= most:
        return False
    held.append(t)
    return True


def request_figures(requests: DataFrame, latest: int = 200) -> DataFrame:
    """One row over the latest requests (event_id, ts, status, latency_ms): total, errors, mean and greatest latency."""
    some = requests.orderBy(F.desc("ts"), F.desc("event_id")).limit(latest)
    return some.agg(F.count("*").alias("total"), F.count_if(F.col("status") >= 400).alias("errors"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.round(F.max("latency_ms"), 6).alias("max_ms"))


def recent_requests(requests: DataFrame, most: int = 10) -> DataFrame:
    """The last requests with their number, the oldest first."""
    return requests.orderBy(F.desc("ts"), F.desc("event_id")).limit(most).withColumn("n", F.row_number().over(Window.orderBy("ts", "event_id")))


def stage_timings(rows: DataFrame) -> DataFrame:
    """Calls, mean and greatest time of each stage (stage, ms)."""
    return rows.groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.max("ms"), 6).alias("max_ms"))


def expired_keys(events: DataFrame, by: str, idle_seconds: int) -> DataFrame:
    """by, last, expired: keys whose last event is more than idle_seconds before the latest event of all."""
    last = events.groupBy(by).agg(F.max("ts").alias("last"))
    now = last.agg(F.max("last").alias("now"))
    gap = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.join(F.broadcast(now)).select(by, "last", (gap > idle_seconds * 1_000_000).alias("expired"))
