import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.operators import evaluation, golden, running, usage
from loomwork.sources.tables import KeyedTable, run_into
from loomwork.streaming.token_bucket import run_to_end, step, token_bucket_stream


def _largest(df, column):
    """Most rows of a partition of what `column` says."""
    return df.groupBy(column).count().agg(F.max("count")).first()[0]


def test_a_hot_key_is_many_ranges(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("source"))
    placed = running.in_ranges(rows, ["source", "id"])
    assert _largest(placed.withColumn("_span", running.span()), "_span") < 0.45 * 4000  # half of the rows have one key
    got = running.numbered_within(rows, "source", ["id"], "n").collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["id"]):
        seen[r["source"]] = seen.get(r["source"], 0) + 1
        assert r["n"] == seen[r["source"]]


def test_numbers_with_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("b", 5), ("a", None)], "k string, v int")
    assert sorted((r["k"] or "", r["v"] or 0, r["n"]) for r in running.numbered_within(rows, "k", ["v"], "n").collect()) == [("", 1, 1), ("", 3, 2), ("a", 0, 1), ("a", 2, 2), ("b", 5, 1)]
    assert sorted((r["n"], r["k"]) for r in running.numbered(rows.filter("k is not null"), ["k", "v"], "n").collect()) == [(1, "a"), (2, "a"), (3, "b")]
    sums = running.running_total(rows.filter("v is not null"), ["v"], F.col("v"), "s").collect()
    assert {r["v"]: r["s"] for r in sums} == {1: 0, 2: 1, 3: 3, 5: 6}
    for out in (running.numbered_within(rows.limit(0), "k", ["v"], "n"), running.running_total(rows.limit(0), ["v"], F.col("v"), "s"), golden.interleaved(rows.limit(0).withColumnRenamed("k", "source"), key="v")):
        assert out.count() == 0


def test_medians(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, 1, 2, 2, 7, 30]), rng.random()) for _ in range(501)] + [("none", None, None), ("even", 1, 1.0), ("even", 4, 2.0)]
    df = spark.createDataFrame(rows, "g string, a int, b double")
    middle = lambda values: statistics.median(values) if values else None
    for g, a, b in ((r["g"], r["a"], r["b"]) for r in running.medians(df, ["a", "b"], ("g",)).collect()):
        assert (a, b) == (middle([x for k, x, _ in rows if k == g and x is not None]), pytest.approx(middle([x for k, _, x in rows if k == g and x is not None])))
    one = running.medians(df, ["a", "b"]).first()
    assert (one["a"], one["b"]) == (middle([x for _, x, _ in rows if x is not None]), pytest.approx(middle([x for _, _, x in rows if x is not None])))
    nothing = running.medians(df.limit(0), ["a"]).collect()
    assert [r["a"] for r in nothing] == [None]
    assert evaluation.latency_summary(spark.createDataFrame([], "ms int, rerank_ms int, top1_score double")).first()["median_ms"] is None


def test_sessions_cut_a_busy_user(spark):
    rng = random.Random(2)
    window, times, now = 1000, [], 0
    for _ in range(3000):
        now += rng.choice([0, 10, 100, 999, 1000, 1500])
        times.append(now)
    rng.shuffle(times)
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(2, 10_000 + i, t) for i, t in enumerate(times[:40])] + [(None, -1, 0), (3, -2, None), (3, -3, 5000)], "user_id long, event_id long, ms long").repartition(5)
    assert _largest(usage.sessions(rows, window), "session") < 100
    want = {}
    for user in (1, 2, 3, None):
        tokens, at = 2.0, None
        own = sorted(((r["ms"], r["event_id"]) for r in rows.collect() if r["user_id"] == user), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for ms, event in own:
            then = at if ms is None else ms
            tokens, after, ok, wait = step(tokens, at, then or 0, 2, window)
            at = None if then is None else after
            want[user, event] = (ok, tokens, wait)
    got = usage.token_bucket(rows, 2, window).collect()
    assert {(r["user_id"], r["event_id"]): (r["ok"], pytest.approx(r["tokens"]), r["retry_ms"]) for r in got} == want
    assert usage.token_bucket(rows.limit(0), 2, window).count() == 0


def test_stream_drops_idle_keys(spark, tmp_path):
    """A user's state goes when the stream has passed its last request by a window, and decisions stay those of the batch."""
    late = [(2, 100 + i, 10_000_000 + i * 70_000) for i in range(6)]
    parts = [[(1, 0, 0), (1, 1, 10), (2, 2, 20)], late[:3], late[3:], [(1, 300, 11_000_000)]]
    schema = "user_id long, event_id long, ms long"
    source = str(tmp_path / "in")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/part={i}")
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run = token_bucket_stream(stream, 2, 60_000).writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination()
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    rows = spark.createDataFrame([r for p in parts for r in p], schema)
    order = ["user_id", "event_id", "ok", "tokens", "retry_ms"]
    assert sorted(spark.table("idle").select(order).collect()) == sorted(usage.token_bucket(rows, 2, 60_000).select(order).collect())
    states = spark.read.format("statestore").option("stateVarName", "bucket").load(str(tmp_path / "state"))
    assert {r[0] for r in states.select("key.user_id").collect()} <= {1, 2} and keys
    again = run_to_end(token_bucket_stream(spark.readStream.schema(schema + ", part int").parquet(source), 2, 60_000), "again")
    assert again.count() == rows.count() and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_keyed_table_replaces_and_counts(spark, tmp_path):
    rows = lambda data: spark.createDataFrame(data, "k long, at int, v string")
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, at int, v string", ["k"], buckets=4)
    assert table.read().count() == 0
    held = lambda t=table: {r["k"]: tuple(r)[1:] for r in t.read().collect()}
    assert table.replace(rows([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")]), ["at"], ("s", 0))
    assert held() == {1: (2, "b"), 2: (1, "c"), None: (1, "n")}
    untouched = table._state()["buckets"]
    assert table.replace(rows([(1, 1, "old"), (5, 9, "new")]), ["at"], ("s", 1))
    assert held() == {1: (2, "b"), 2: (1, "c"), None: (1, "n"), 5: (9, "new")}
    touched = {r[0] for r in rows([(1, 1, ""), (5, 1, "")]).select(table._bucket()).collect()}
    now = table._state()["buckets"]
    assert {b for b in now if now[b] != untouched.get(b)} == {str(b) for b in touched}
    assert not table.replace(rows([(1, 99, "again")]), ["at"], ("s", 1)) and held()[1] == (2, "b")  # the same batch once more
    assert table.replace(rows([]), ["at"], ("s", 2)) and held(KeyedTable(spark, str(tmp_path / "t"), "k long, at int, v string", ["k"], buckets=4))[5] == (9, "new")

    counts = KeyedTable(spark, str(tmp_path / "c"), "user_id long, day string, blocked long", ["user_id", "day"], buckets=3)
    one = spark.createDataFrame([(1, "d", 1)] * 500 + [(2, "d", 1), (None, "d", 1)], "user_id long, day string, blocked long")
    for _ in range(2):  # written twice, counted once
        counts.count_up(one, ["blocked"], ("gate", 7))
    counts.count_up(one.filter("user_id = 1"), ["blocked"], ("gate", 8))
    assert {(r["user_id"], r["blocked"]) for r in counts.read().collect()} == {(1, 1000), (2, 1), (None, 1)}


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "user_id long, n long", ["user_id"], buckets=2)
    source = str(tmp_path / "in")
    rows = spark.range(40).select((F.col("id") % 3).alias("user_id"), F.lit(1).cast("long").alias("n"))
    rows.coalesce(2).write.parquet(source)
    calls = []

    def write(part, batch):
        calls.append(table.count_up(part, ["n"], batch))
        calls.append(table.count_up(part, ["n"], batch))  # as after a failure between write and checkpoint

    run_into(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), "counts", str(tmp_path / "state"), write)
    assert calls == [True, False] * (len(calls) // 2) and calls
    assert {r["user_id"]: r["n"] for r in table.read().collect()} == {0: 14, 1: 13, 2: 13}


def test_common_length_against_brute_force():
    def brute(a, b):
        return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)

    rng = random.Random(0)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "词语é😀"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(2))
        b += a[3:20] if rng.random() < 0.3 else ""
        assert text.common_length(a, b) == brute(a, b)


def test_long_texts_in_common_and_in_paragraphs(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choices("abcdefgh", k=200_000)) for _ in range(2))
    assert text.common_length(a, b[:1000] + a[500:50_500] + b[1000:]) >= 50_000
    assert len(text.merged(["x" * 30] * 100_000)) == 25_000
    df = spark.createDataFrame([(["a" * 50, "b" * 80, "c" * 10],), (["d" * 5],), ([],), (None,), (["e" * 24],)], "p array<string>")
    assert [r[0] for r in df.select(text.merge_short(F.col("p"))).collect()] == [["a" * 50 + "\n" + "b" * 80 + "\n" + "c" * 10], [], [], None, ["e" * 24]]
