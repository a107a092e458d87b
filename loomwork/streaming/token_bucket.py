"""The token bucket over a stream, with one state a key that goes when a window has passed without requests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loomwork.sources.shared import shared_path

OUTPUT = "user_id long, event_id long, ms long, ok boolean, tokens double, retry_ms long"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Added to times where Spark sees them, as it takes times up to 1970 for late ones.
SHIFT_MS = 100 * 365 * 86_400_000


def step(tokens: float, at: int | None, ms: int, limit: int, window_ms: int) -> tuple[float, int, bool, int]:
    """Tokens, time, ok and wait after a request at ms."""
    elapsed = max(0, ms - (ms if at is None else at))
    held = min(float(limit), tokens + elapsed * limit / window_ms)
    at = ms if at is None else max(at, ms)
    if held >= 1:
        return held - 1, at, True, 0
    return held, at, False, math.ceil((1 - held) / (limit / window_ms))


class Bucket(StatefulProcessor):
    """The tokens and the time of a key's last request, and one timer a window after it."""

    def __init__(self, limit: int, window_ms: int, drop_idle: bool):
        self.limit, self.window_ms, self.drop_idle = limit, window_ms, drop_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tokens double, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        tokens, at = held if held else (float(self.limit), None)
        before = at
        for part in rows:  # some thousand rows at a time, whatever the key has
            part = part.sort_values(["ms", "event_id"], kind="stable")
            out = []
            for ms in part["ms"]:
                tokens, at, ok, wait = step(tokens, at, int(ms), self.limit, self.window_ms)
                out.append((ok, tokens, wait))
            decided = pd.DataFrame(out, columns=["ok", "tokens", "retry_ms"], index=part.index)
            yield pd.concat([part[["user_id", "event_id", "ms"]], decided], axis=1)
        if self.drop_idle and at is not None and at != before:
            if before is not None:
                self.handle.deleteTimer(SHIFT_MS + before + self.window_ms)
            self.handle.registerTimer(SHIFT_MS + at + self.window_ms)
        if at is not None:
            self.state.update((tokens, at))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()  # full again, like a key never seen
        return iter(())

    def close(self) -> None:
        pass


def token_bucket_stream(rows: DataFrame, limit: int, window_ms: int, drop_idle: bool = True, late_ms: int | None = None) -> DataFrame:
    """Decisions for a streaming DataFrame of user_id, event_id, ms (none null).

    A key's requests are folded as they come, a chunk of rows at a time in order of time, so no key's rows are gathered; where
    they come in order of time the decisions are those of the batch operator. With drop_idle a key's state goes when the stream's event time has
    passed its last request by a window: its bucket is full then, like one never seen. The watermark stays `late_ms` (a window,
    if not given) behind the latest request; Spark leaves out rows that come later than that. The state lives in
    RocksDB, which the session must name as its state store (`run_to_end` does for its run)."""
    late = window_ms if late_ms is None else late_ms
    timed = rows.select("user_id", "event_id", "ms", F.timestamp_millis(F.col("ms") + SHIFT_MS).alias("at")).withWatermark("at", f"{late} milliseconds")
    return timed.groupBy("user_id").transformWithStateInPandas(Bucket(limit, window_ms, drop_idle), OUTPUT, "append", "eventTime")


def run_to_end(rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what its source holds now, and gives what it wrote as a table.

    Executors write the rows and the state to the shared folder, so none pass through the driver. They go
    when the driver ends. The session's state store is set for the start of the run and put back."""
    spark = rows.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        run = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], before)
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")
