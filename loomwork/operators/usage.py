"""Usage accounting: daily budgets with serial meaning, block counters, and token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.scalars import day_key
from loomwork.operators.running import in_ranges, span
from loomwork.sources.shared import stored
from loomwork.streaming.token_bucket import step


def with_day(rows: DataFrame, ts: str = "ts", offset_minutes: int = 0) -> DataFrame:
    return rows.withColumn("day", day_key(F.col(ts).cast("timestamp"), offset_minutes))


def budget_daily(rows: DataFrame) -> DataFrame:
    """user_id, day, calls (not degraded), tokens (of all rows). rows: user_id, day, degraded, tokens."""
    return rows.groupBy("user_id", "day").agg(F.count_if(~F.col("degraded")).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def budget_decision(state: DataFrame, call_limit: int, token_limit: int) -> DataFrame:
    """state (calls, tokens) with decision: calls before tokens; a limit of 0 is none."""
    calls = F.lit(call_limit > 0) & (F.col("calls") >= call_limit)
    tokens = F.lit(token_limit > 0) & (F.col("tokens") >= token_limit)
    return state.withColumn("decision", F.when(calls, "calls").when(tokens, "tokens").otherwise("ok"))


def budget_gate(rows: DataFrame, call_limit: int, token_limit: int, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """rows with decision: what each call, in its order, gets from its user's calls and the day's tokens.

    Blocked calls count neither as calls nor as tokens. The tokens of a day are everybody's, so their
    running sum is per day; it is summed first within spans of a minute, so a day's window holds
    1440 rows, and then within each span."""
    per_user = Window.partitionBy("user_id", "day").orderBy(order, tie)
    allowed = F.lit(call_limit <= 0) | (F.col("_rn") <= call_limit)
    rows = rows.withColumn("_rn", F.row_number().over(per_user)).withColumn("_cost", F.when(allowed, F.col("tokens")).otherwise(0))
    rows = rows.withColumn("_span", F.floor(F.unix_micros(F.col(order).cast("timestamp")) / 60_000_000))
    spans = rows.groupBy("day", "_span").agg(F.sum("_cost").alias("_sum"))
    before_span = Window.partitionBy("day").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("day", "_span", F.coalesce(F.sum("_sum").over(before_span), F.lit(0)).alias("_spans_before"))
    in_span = Window.partitionBy("day", "_span").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(spans, ["day", "_span"])
    spent = F.col("_spans_before") + F.coalesce(F.sum("_cost").over(in_span), F.lit(0))
    rows = rows.withColumn("_cut", F.lit(token_limit > 0) & (spent >= token_limit)).withColumn("_ok", (allowed & ~F.col("_cut")).cast("int"))
    prior = F.coalesce(F.sum("_ok").over(per_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_calls = F.lit(call_limit > 0) & (prior >= call_limit)
    return rows.withColumn("decision", F.when(by_calls, "calls").when(F.col("_cut"), "tokens").otherwise("ok")).drop("_rn", "_cost", "_span", "_spans_before", "_cut", "_ok")


def blocked_counter(decided: DataFrame) -> DataFrame:
    """user_id, day, blocked: one row for each user and day with blocked calls."""
    return decided.filter("decision != 'ok'").groupBy("user_id", "day").agg(F.count("*").alias("blocked"))


def sessions(rows: DataFrame, window_ms: int) -> DataFrame:
    """rows (user_id, event_id, ms) with session and _at: a user's requests in order of time, cut wherever a whole window is free of them.

    After such a gap the bucket is full, as for a user never seen, so sessions are independent of each other. Rows are sorted in ranges of
    user and time; a range's first row looks at the last one of the range before, which are one row a range. Rows without a
    time come first and belong to the user's first session."""
    placed = in_ranges(rows, ["user_id", "ms", "event_id"]).withColumn("_span", span())
    ends = placed.groupBy("_span").agg(F.max_by(F.struct("user_id", "ms"), "_at").alias("_end"), F.count("*").alias("_n"))
    before = ends.select("_span", F.lag("_end").over(Window.orderBy("_span")).alias("_last"))
    own = Window.partitionBy("_span").orderBy("_at")
    met = placed.join(F.broadcast(before), "_span").withColumn("_before", F.coalesce(F.lag(F.struct("user_id", "ms")).over(own), F.col("_last")))
    same = F.col("_before").isNotNull() & F.col("user_id").eqNullSafe(F.col("_before.user_id"))
    gap = F.coalesce(F.col("ms") - F.col("_before.ms") >= window_ms, F.lit(False))
    begun = stored(met.withColumn("_start", (~same | gap).cast("int")).drop("_before", "_last"), "sessions")
    starts = begun.groupBy("_span").agg(F.sum("_start").alias("_starts"))
    ahead = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select("_span", F.coalesce(F.sum("_starts").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.sum("_start").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begun.withColumn("session", inside).join(F.broadcast(offsets), "_span").withColumn("session", F.col("session") + F.col("_ahead")).drop("_span", "_start", "_ahead")


def token_bucket(rows: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """user_id, event_id, ms, ok, tokens, retry_ms: each request of a key in order of time.

    rows: user_id, event_id, ms. A key's bucket starts full and refills evenly; a request takes one
    token or is told when one will be there; a clock that goes back refills nothing. Requests are dealt by session
    (see `sessions`), so a busy user is many tasks' work wherever a window was free; a task holds the tokens and the time of one
    session and a batch of rows."""
    if limit <= 0 or window_ms <= 0:
        return rows.select("user_id", "event_id", "ms", F.lit(True).alias("ok"), F.lit(0.0).alias("tokens"), F.lit(0).cast("long").alias("retry_ms"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, at = object(), 0.0, None
        for batch in batches:
            ok, left, wait = [], [], []
            for session, ms in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if session != key:
                    key, tokens, at = session, float(limit), None
                now = at if ms is None else ms  # without a time: when the request before came
                tokens, then, taken, retry = step(tokens, at, now or 0, limit, window_ms)
                at = None if now is None else then
                ok.append(taken)
                left.append(tokens)
                wait.append(retry)
            added = [pa.array(ok, pa.bool_()), pa.array(left, pa.float64()), pa.array(wait, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], ["user_id", "event_id", "ms", "ok", "tokens", "retry_ms"])

    requests = rows.select("user_id", F.col("event_id").cast("long").alias("event_id"), F.col("ms").cast("long").alias("ms"))
    schema = T.StructType([*requests.schema, T.StructField("ok", T.BooleanType()), T.StructField("tokens", T.DoubleType()), T.StructField("retry_ms", T.LongType())])
    dealt = sessions(requests, window_ms).repartition("session").sortWithinPartitions("session", "_at")
    return dealt.select("user_id", "event_id", "ms", "session").mapInArrow(fold, schema)
