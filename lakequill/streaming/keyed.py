"""Streams with a state for each key: admission in a sliding window, and keys that fall idle.

Both wait for the watermark: an event is judged once no earlier one can come, in the order of time and id, so that a
stream gives what the batch form gives. Rows later than the watermark are dropped and counted by Spark
(numRowsDroppedByWatermark in the query's progress). They need the RocksDB state store, see `started`.
"""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lakequill.streaming.events import admits

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after(t: int) -> int:
    """The first whole millisecond after t (microseconds): a timer there fires when the watermark has passed t."""
    return t // 1000 + 1


class Waiting(StatefulProcessor):
    """Holds each key's rows back until the watermark passes them; `judge` gets those that are due, in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t long, event_id long")
        self.held = handle.getListState("held", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = [r for pdf in rows for r in zip(pdf["t"].tolist(), pdf["event_id"].tolist(), strict=True)]
        if came:
            self.rows.appendList(came)
            self.handle.registerTimer(after(min(t for t, _ in came)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((r[0], r[1]) for r in self.rows.get())
        due = [r for r in rows if after(r[0]) <= now]
        if due:
            self.put(self.rows, rows[len(due) :])
        if len(due) < len(rows):
            self.handle.registerTimer(after(rows[len(due)][0]))
        return self.judge(key, due, now)

    def put(self, state: object, values: list[tuple]) -> None:
        if values:
            state.put(values)
        else:
            state.clear()

    def judge(self, key: tuple, due: list[tuple[int, int]], now: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Admission(Waiting):
    def __init__(self, by: str, window_seconds: int, most: int):
        self.by, self.window_seconds, self.most = by, window_seconds, most

    def judge(self, key: tuple, due: list[tuple[int, int]], now: int) -> Iterator[pd.DataFrame]:
        held = deque(r[0] for r in self.held.get())
        ok = [admits(held, t, self.window_seconds, self.most) for t, _ in due]
        while held and after(held[0] + self.window_seconds * 1_000_000) <= now:  # no event to come can meet them
            held.popleft()
        self.put(self.held, [(t,) for t in held])
        if held:
            self.handle.registerTimer(after(held[-1] + self.window_seconds * 1_000_000))  # then the key's state goes
        if due:
            yield pd.DataFrame({self.by: [key[0]] * len(due), "event_id": [i for _, i in due], "ok": ok})


class Idle(Waiting):
    def __init__(self, by: str, idle_seconds: int):
        self.by, self.idle = by, idle_seconds * 1_000_000

    def judge(self, key: tuple, due: list[tuple[int, int]], now: int) -> Iterator[pd.DataFrame]:
        last, ends = next((r[0] for r in self.held.get()), None), []
        for t, _ in due:
            if last is not None and t - last > self.idle:
                ends.append(last)
            last = t
        if last is not None and after(last + self.idle) <= now:
            ends.append(last)
            last = None
        self.put(self.held, [] if last is None else [(last,)])
        if last is not None:
            self.handle.registerTimer(after(last + self.idle))
        if ends:
            yield pd.DataFrame({self.by: [key[0]] * len(ends), "last": pd.to_datetime(ends, unit="us", utc=True)})


def keyed(events: DataFrame, by: str, late: str, processor: Waiting, schema: str) -> DataFrame:
    """Rows without a key, a time or an id take no part."""
    rows = events.where(F.col(by).isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull()).select(by, F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return rows.groupBy(by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stream_admitted(events: DataFrame, by: str, window_seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """events.admitted over a stream (by, event_id, ts). A key keeps the admitted times of its window, `most` at most,
    and the rows that the watermark hasn't passed; when the window has left the last one behind, nothing is kept."""
    return keyed(events, by, late, Admission(by, window_seconds, most), f"`{by}` {events.schema[by].dataType.simpleString()}, event_id long, ok boolean")


def stream_idle(events: DataFrame, by: str, idle_seconds: int, late: str = "10 minutes") -> DataFrame:
    """by, last: a row whenever a key has had no event for more than idle_seconds; its state goes with it."""
    return keyed(events, by, late, Idle(by, idle_seconds), f"`{by}` {events.schema[by].dataType.simpleString()}, last timestamp")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start within use the RocksDB state store."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def started(rows: DataFrame, folder: str) -> StreamingQuery:
    """Runs what the stream's source holds now into a Parquet sink under folder; a later call goes on from there."""
    with rocks(rows.sparkSession):
        query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def written(rows: DataFrame, folder: str) -> DataFrame:
    """The sink's table after `started`."""
    started(rows, folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
