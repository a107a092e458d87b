import pytest
from pyspark.sql import functions as F

from loomwork.operators import evaluation, golden, matching, retrieval, usage
from loomwork.sources import files, rules
from loomwork.streaming.token_bucket import step


def test_bm25_toy(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "red red bird"), (3, "!!!"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red red fish"), (8, "none")], "query_id long, query string")
    got = retrieval.bm25(docs, queries, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(7, 1), (7, 2)]
    stats = retrieval.corpus_stats(docs).first()
    assert (stats["n_docs"], stats["n_terms"], stats["n_tokens"], stats["avgdl"]) == (4, 3, 5, 1.25)
    assert retrieval.bm25(docs, queries, 0).count() == 0
    assert retrieval.bm25(docs.limit(0), queries).count() == 0


def test_fusion_prefers_both_routes(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 5)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 20, 5)], "query_id long, id long, rank int")
    assert [r["id"] for r in retrieval.fused([a, b], 5).orderBy("rank").collect()] == [20, 10]


def test_partial_rerank(spark):
    base = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id long, id long, rank int")
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.5)], "query_id long, id long, rerank_score double")
    assert [r["id"] for r in retrieval.reranked(base, scores, 3).orderBy("rank").collect()] == [2, 3, 1, 4, 5]


def test_modes():
    assert retrieval.parse_mode("hybrid+rerank20") == retrieval.Mode("hybrid", 20)
    assert retrieval.parse_mode(None) == retrieval.Mode("dense") and retrieval.parse_mode("best") is None
    assert (retrieval.pool_size(5, None, False), retrieval.pool_size(80, None, False), retrieval.pool_size(5, None, True)) == (50, 80, 100)


def test_search_refuses_unknown_modes_and_lengths(spark):
    chunks = spark.createDataFrame([(1, "a", "s", [1.0, 0.0])], "id long, text string, source string, embedding array<double>")
    queries = spark.createDataFrame([(1, "a", [1.0])], "query_id long, query string, q array<double>")
    with pytest.raises(ValueError):
        retrieval.search(chunks, queries, "best")
    with pytest.raises(ValueError):
        retrieval.search(chunks, queries, "dense")


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 8)] + [(2, i, i) for i in range(1, 8)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, [1, 99], "x"), (2, [6], "x"), (3, [], "x"), (4, [5], "x")], "query_id long, gold array<long>, category string")
    rows = evaluation.retrieval_rows(ranked, gold)
    m = evaluation.retrieval_metrics(rows).first()
    assert (m["n"], m["misses"]) == (3, 1)
    assert (m["recall_1"], m["hit_1"]) == pytest.approx((1 / 6, 1 / 3))
    assert m["mrr_5"] == pytest.approx(1 / 3)
    p = evaluation.production_metrics(rows).first()
    assert (p["hit_recall"], p["mrr"]) == pytest.approx((2 / 3, (1 + 1 / 6) / 3))


def test_judges(spark):
    rows = [("a", 0, 1, 1, 1, "one"), ("a", 1, 2, 2, 2, "two"), ("a", 2, 5, 5, 5, "five"), ("b", 0, 3, 3, 3, "x"), ("b", 1, None, None, None, None), ("b", 2, None, None, None, None)]
    samples = spark.createDataFrame(rows, "id string, idx int, faithfulness int, relevance int, sufficiency int, reasoning string")
    got = {r["id"]: r for r in evaluation.judge_aggregate(samples, 3).collect()}
    assert (got["a"]["faithfulness"], got["a"]["reasoning"], got["a"]["failed"]) == (2, "two", False)
    assert got["b"]["failed"] and got["b"]["faithfulness"] is None
    with pytest.raises(ValueError):
        evaluation.judge_aggregate(samples, 2)
    assert evaluation.answer_summary(samples).count() == 15
    assert evaluation.answer_means(samples.limit(0).withColumn("answer_ms", F.lit(1))).first()["mean_relevance"] == 0.0


def test_golden(spark):
    items = spark.createDataFrame(
        [("q", "a", "ev　idence", "the ev idence", "odd", "easy"), (" ", "a", "e", "e", None, None), ("q", "a", "made up", "text", "numeric", "hard"), ("what is a", "a", "e", "e", "numeric", "hard"), ("书里 what", "b", "e", "e", "numeric", "hard")],
        "question string, reference_answer string, evidence string, chunk string, category string, difficulty string",
    )
    got = golden.validated(items).collect()
    assert [r["reason"] for r in got] == [None, "missing question or answer", "evidence not in chunk", "answer repeats question", "question refers to the text"]
    assert (got[0]["category"], got[0]["difficulty"]) == ("factual", "easy") and got[1]["difficulty"] == "medium"
    last = spark.createDataFrame([("x", 998)], "slug string, last int")
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "slug string, k int")
    assert {r["golden_id"] for r in golden.numbered(rows, last, ["k"]).collect()} == {"x-999", "x-1000", "y-001"}


def test_rule_tables(spark):
    e, p, r = rules.exercises(spark), rules.plans(spark), rules.recipes(spark)
    assert (e.count(), p.count(), r.count()) == (20, 5, 14)
    assert min(x["count"] for x in e.groupBy("muscle_group").count().collect()) >= 3
    assert min(x["count"] for x in r.groupBy("category").count().collect()) >= 3
    assert p.select(F.explode("exercises.exercise_id").alias("id")).join(e, "id", "left_anti").count() == 0


def test_matching(spark):
    r = rules.recipes(spark)
    targets = spark.createDataFrame([(1, 300.0), (2, 9999.0)], "target_id long, kcal double")
    got = matching.calorie_match(r, targets).collect()
    assert all(270 <= x["calories"] <= 330 for x in got if x["target_id"] == 1)
    assert [x["id"] for x in got if x["target_id"] == 2] == ["beef-burger"]
    goals = spark.createDataFrame([(1, 1500.0, 0.4, 0.4, 0.2), (2, 3000.0, 0.6, 0.3, 0.1), (3, 1500.0, 1.0, 0.0, 0.0)], "target_id int, kcal double, carbs double, protein double, fat double")
    plans = {x["target_id"]: x for x in matching.meal_plans(r, goals).collect()}
    assert set(plans) == {1, 2}
    kcal = {x["id"]: (x["ord"], x["calories"]) for x in r.collect()}
    assert plans[1]["calories"] == sum(kcal[plans[1][m]][1] for m in ("breakfast", "lunch", "dinner"))
    assert kcal[plans[1]["lunch"]][0] <= kcal[plans[1]["dinner"]][0]
    asked = spark.createDataFrame([(1, "back"), (2, "neck")], "request_id int, muscle_group string")
    assert {x["request_id"]: x["plan_id"] for x in matching.plan_for(asked, rules.plans(spark)).collect()} == {1: "back-day", 2: "chest-day"}


@pytest.mark.parametrize("state, limits, expected", [((49, 999), (50, 1000), "ok"), ((50, 0), (50, 1000), "calls"), ((0, 1000), (50, 1000), "tokens"), ((50, 1000), (50, 1000), "calls"), ((99, 9999), (0, 0), "ok")])
def test_budget_decision(spark, state, limits, expected):
    rows = spark.createDataFrame([state], "calls long, tokens long")
    assert usage.budget_decision(rows, *limits).first()["decision"] == expected


def test_budget_gate_is_serial(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.randrange(4), f"2026-01-0{1 + i // 60} 00:{i % 60:02d}:00", rng.randrange(30)) for i in range(120)]
    df = usage.with_day(spark.createDataFrame(rows, "event_id long, user_id long, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp")))
    got = {r["event_id"]: r["decision"] for r in usage.budget_gate(df, 5, 200).collect()}
    calls, spent = {}, {}
    for i, user, ts, tokens in rows:
        day = ts[:10]
        d = "calls" if calls.get((user, day), 0) >= 5 else "tokens" if spent.get(day, 0) >= 200 else "ok"
        if d == "ok":
            calls[user, day] = calls.get((user, day), 0) + 1
            spent[day] = spent.get(day, 0) + tokens
        assert got[i] == d


def test_token_bucket(spark):
    times = [0] * 11 + [6000, 3_600_000, 3_550_000]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id long, event_id long, ms long")
    got = sorted(usage.token_bucket(rows, 10, 60_000).collect(), key=lambda r: r["event_id"])
    assert [r["ok"] for r in got] == [True] * 10 + [False, True, True, True]
    assert got[0]["tokens"] == 9 and got[10]["retry_ms"] == 6000
    assert all(r["ok"] for r in usage.token_bucket(rows, 0, 60_000).collect())


def test_stream_step_clock_rollback():
    assert step(3.0, 100_000, 50_000, 10, 60_000) == (2.0, 100_000, True, 0)


def test_stream_equals_batch(spark, tmp_path):
    from loomwork.streaming.token_bucket import token_bucket_stream

    rows = spark.createDataFrame([(i % 3, i, i * 7000) for i in range(60)], "user_id long, event_id long, ms long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = token_bucket_stream(stream, 2, 120_000, drop_idle=False).writeStream.format("memory").queryName("bucket_test").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    order = ["user_id", "event_id", "ok"]
    assert sorted(spark.table("bucket_test").select(order).collect()) == sorted(usage.token_bucket(rows, 2, 120_000).select(order).collect())


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x" * 500)
    (tmp_path / "a.txt").write_text("y" * 130)
    (tmp_path / "skip.md").write_text("z")
    chunks = files.with_chunk_ids(files.chunk_table(files.text_corpus(spark, str(tmp_path)))).orderBy("id").collect()
    assert [(r["id"], r["source"], r["meta"]) for r in chunks] == [(1, "a", "chunk-0"), (2, "b", "chunk-0"), (3, "b", "chunk-1")]
    (tmp_path / "g.jsonl").write_text('{"id":"s-007","question":"q　1","gold_chunk_ids":[3]}\n\n')
    state = files.resume_state(files.json_lines(spark, str(tmp_path / "g.jsonl")))
    assert state.last_numbers.first()["last"] == 7 and state.used_chunks.first()["chunk_id"] == 3 and state.seen_questions.first()["question"] == "q1"


@pytest.mark.parametrize("value, least, expected", [("5", 0, 5), ("5.5", 0, 9), ("-1", 0, 9), ("0", 1, 9), (None, 0, 9), ("x", 0, 9), ("", 0, 0), ("-5", -720, -5)])
def test_read_int(value, least, expected):
    assert files.read_int(value, 9, least) == expected


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "user_id long, day string, degraded boolean, tokens long")
    assert usage.budget_daily(empty).count() == 0
    assert retrieval.corpus_stats(spark.createDataFrame([], "text string")).first()["avgdl"] == 0.0


def test_batched_scorer_cuts_texts_and_fails_softly(spark):
    def model(pairs):
        if any("bad" in q for q, _ in pairs):
            raise RuntimeError("no model")
        return [float(len(t.split())) - 2 for _, t in pairs]

    score = retrieval.batched_scorer(model, batch=1, most_tokens=4)
    rows = spark.createDataFrame([("a b", "x y z z z"), ("a b", None), ("bad", "x")], "q string, t string").coalesce(1)
    got = [r["s"] for r in rows.select(score("q", "t").alias("s")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] < 0.5 and got[2] is None


def test_search_checks_every_vector(spark):
    chunks = spark.createDataFrame([(1, "a", "s", [1.0, 0.0]), (2, "b", "s", [1.0])], "id long, text string, source string, embedding array<double>")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, query string, q array<double>")
    with pytest.raises(ValueError):
        retrieval.search(chunks, asked, "dense")


def test_bm25_bounds_change_nothing(spark):
    """Every query's best texts are those of a plain sum over all terms."""
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = {i: [words[int(40 * rng.random() ** 3)] for _ in range(rng.randrange(0, 60))] for i in range(150)}
    asked = {i: rng.sample(words, 6) + ["w0", "nowhere"] for i in range(12)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(900, None)], "doc_id long, text string")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.bm25(df, spark.createDataFrame([(i, " ".join(q)) for i, q in asked.items()], "query_id long, query string"), 5).collect()}
    n, avg = len(docs) + 1, sum(map(len, docs.values())) / (len(docs) + 1)
    count = {i: Counter(w) for i, w in docs.items()}
    df_ = Counter(t for c in count.values() for t in c)
    want = {}
    for q, terms in asked.items():
        score = {i: sum(math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(docs[i]) / avg)) for t in set(terms) if c[t]) for i, c in count.items()}
        best = sorted((i for i in score if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:5]
        want |= {(q, k + 1): i for k, i in enumerate(best)}
    assert got == want


def test_other_gold(spark):
    hits = spark.createDataFrame([(1, 5, 2, "the quoted evidence text here", "quoted evidence text"), (1, 6, 3, "near", "quoted evidence text"), (1, 7, 4, "far", "quoted evidence text")], "query_id long, id long, rank int, text string, evidence string")
    centre = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, centroid array<double>")
    vectors = spark.createDataFrame([(5, [0.0, 1.0]), (6, [0.9, 0.1]), (7, [0.0, 1.0])], "id long, v array<double>")
    assert {(r["id"], r["kind"]) for r in golden.other_gold(hits, centre, vectors).collect()} == {(5, "strong"), (6, "similar")}


def test_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "mode string, n int")
    for _ in range(2):
        files.append_json_lines(rows, f"{tmp_path}/lines")
    assert files.json_lines(spark, f"{tmp_path}/lines", "mode string, n int").count() == 4
    files.write_report(rows, f"{tmp_path}/report")
    files.write_report(rows.filter("mode = 'b'").withColumn("n", F.lit(9)), f"{tmp_path}/report")
    assert {tuple(r) for r in spark.read.json(f"{tmp_path}/report").select("mode", "n").collect()} == {("a", 1), ("b", 9)}
