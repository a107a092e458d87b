import pytest
from pyspark.sql import functions as F

from loomwork.operators import golden, usage
from loomwork.plans import catalog
from loomwork.sources import files
from loomwork.streaming.token_bucket import step


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """One passage, held by document 60, which the vectors put at rank 60 and the terms at rank 1."""
    d = str(tmp_path_factory.mktemp("deep"))
    docs = spark.range(1, 121).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 60, "needle in hay").otherwise("straw").alias("text"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "needle")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    angle = (F.col("id") - 1) / 100.0
    spark.range(1, 121).select(F.col("id").alias("vec_id"), F.array(F.cos(angle), F.sin(angle)).cast("array<float>").alias("embedding")).write.parquet(f"{d}/embeddings.parquet")
    return d


def test_metrics_see_to_rank_100(spark, deep):
    got = {r["mode"]: r for r in catalog.QUERIES["retrieval_metrics"](spark, deep).collect()}
    assert (got["dense"]["hit_50"], got["dense"]["hit_100"], got["dense"]["recall_100"], got["dense"]["misses"]) == (0, 1, 1, 0)
    by_group = {r["mode"]: r for r in catalog.QUERIES["metrics_by_group"](spark, deep).collect()}
    assert (by_group["dense"]["hit_50"], by_group["dense"]["hit_100"]) == (0, 1)


def test_production_counts_the_first_five(spark, deep, monkeypatch):
    at = {r["mode"]: (r["hit_recall"], r["mrr"]) for r in catalog.QUERIES["production_metrics"](spark, deep).collect()}
    assert at["bm25"] == (1, 1) and at["dense"] == (0, 0)
    rows = spark.createDataFrame([(1, i, i) for i in range(40, 90)], "query_id long, id long, rank int").withColumn("rank", F.col("rank") - 39)
    monkeypatch.setattr(catalog, "_routes", lambda *a: {"dense": rows})
    r = catalog.QUERIES["production_metrics"](spark, deep).first()  # document 60 is at rank 21
    assert (r["hit_recall"], r["mrr"]) == (0, 0)


def test_production_counts_the_whole_pool_too(spark, deep, monkeypatch):
    rows = spark.createDataFrame([(1, i, i - 39) for i in range(40, 90)], "query_id long, id long, rank int")
    monkeypatch.setattr(catalog, "_routes", lambda *a: {"dense": rows})
    r = catalog.QUERIES["production_metrics"](spark, deep).first()  # document 60 is at rank 21
    assert (r["hit_recall"], r["mrr"], r["pool_recall"], r["pool_mrr"]) == (0, 0, 1, round(1 / 21, 9))
    served = catalog.QUERIES["served_metrics"](spark, deep)
    assert served.columns == ["mode", "n", "hit_recall", "mrr"] and served.first()["hit_recall"] == 0


def test_sweep_fuses_at_each_depth(spark, monkeypatch):
    """Document 7 is at 3 by terms and at 30 by vectors: at depth 20 one route holds it, and from 50 on both do.

    Document 9 is at 150 by vectors alone, so only depth 200 holds it, after document 8."""
    dense = spark.createDataFrame([(1, i, i - 100) for i in range(101, 301) if i != 130] + [(1, 7, 30), (2, 9, 150)], "query_id long, id long, rank int")
    terms = spark.createDataFrame([(1, 101, 2), (1, 7, 3), (2, 8, 1)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, [7], "one"), (2, [9], "one")], "query_id long, gold array<long>, category string")
    monkeypatch.setattr(catalog, "_routes", lambda *a: {"dense": dense, "bm25": terms, "hybrid": dense})
    monkeypatch.setattr(catalog, "_gold", lambda *a: gold)
    got = {r["depth"]: r for r in catalog.QUERIES["fusion_depth_sweep"](spark, "").collect()}
    assert {d: (r["n"], r["misses"], r["in_pool_share"], r["n_changed"]) for d, r in got.items()} == {20: (2, 1, 0.5, 0), 50: (2, 1, 0.5, 1), 100: (2, 1, 0.5, 1), 200: (2, 0, 1, 2)}
    assert {d: r["mrr_5"] for d, r in got.items()} == pytest.approx({20: 1 / 6, 50: 1 / 4, 100: 1 / 4, 200: 1 / 2})


def test_curation_shuffles_no_texts(spark, monkeypatch):
    docs = spark.range(40).select("id", F.concat(F.lit("some words "), "id").alias("text"))
    ranked = spark.range(1, 11).select(F.lit(1).cast("long").alias("query_id"), "id", F.col("id").cast("int").alias("rank"))
    gold = spark.createDataFrame([(1, [2, 30], "many"), (2, [77], "one")], "query_id long, gold array<long>, category string")
    evidence = spark.createDataFrame([(1, "some words in full 1"), (2, "x")], "query_id long, evidence string")
    vectors = spark.range(40).select("id", F.array(F.lit(1.0), F.col("id") / 100).alias("v"))
    met, whole = [], golden.other_gold
    monkeypatch.setattr(golden, "other_gold", lambda hits, *a: met.append(hits) or whole(hits, *a))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries, others = golden.curation_entries(ranked, gold, docs, evidence, vectors)
        plan = met[0]._jdf.queryExecution().executedPlan().toString()
        rows = {r["id"]: (r["first_rank"], r["n_similar"]) for r in entries.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and met[0].count() == 9
    assert rows == {1: (2, 3), 2: (None, 0)} and others.count() == 3  # the gold of query 2 has no document


def test_interleave_takes_every_row(spark, tmp_path):
    rows = [(i, "a") for i in range(1, 41)] + [(i, "b") for i in range(50, 53)] + [(60, "c"), (61, None)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["turn"]) for r in catalog.QUERIES["golden_interleave"](spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(61, 1), (1, 1), (50, 1), (60, 1), (2, 2), (51, 2), (3, 3), (52, 3), *((i, i) for i in range(4, 41))]
    seeded = golden.interleaved(spark.createDataFrame(rows, "id long, source string"), seed=3).collect()
    assert sorted(r["place"] for r in seeded) == list(range(1, 46))


def test_golden_filter_has_the_rules_of_the_pool(spark, tmp_path):
    texts = ["a" * 149 + " ", "词" * 37 + "a" * 113, "词" * 36 + "a" * 300, "，" + "词" * 200, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"] for r in catalog.QUERIES["golden_filter"](spark, str(tmp_path)).filter("long_enough").collect()}
    assert got == {1} == {r["doc_id"] for r in golden.question_pool(docs).collect()}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stream_decisions_are_read_from_files(spark, tmp_path):
    events = spark.range(60).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_millis(F.col("id") * 7_000_000).alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["rate_limit_stream"](spark, str(tmp_path))
    assert got.inputFiles()  # a memory sink's table has none
    assert sorted(got.collect()) == sorted(catalog.QUERIES["token_bucket"](spark, str(tmp_path)).collect())


def test_token_bucket_of_a_busy_user(spark):
    times = [(i * 7919) % 30_011 * 50 for i in range(30_000)]  # over several Arrow batches, not in order
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(2, -1, None), (2, 0, 0), (None, 0, 0)], "user_id long, event_id long, ms long")
    out = usage.token_bucket(rows, 3, 1000)
    assert "collect_list" not in _plan(out)
    tokens, at, want = 3.0, None, {}
    for i in sorted(range(30_000), key=lambda i: (times[i], i)):
        tokens, at, ok, wait = step(tokens, at, times[i], 3, 1000)
        want[1, i] = (ok, tokens, wait)
    want |= {(2, -1): (True, 2.0, 0), (2, 0): (True, 1.0, 0), (None, 0): (True, 2.0, 0)}
    assert {(r["user_id"], r["event_id"]): (r["ok"], r["tokens"], r["retry_ms"]) for r in out.collect()} == want


def test_chunk_ids_need_no_window_of_all_keys(spark):
    chunked = spark.range(3000).select((F.col("id") * 17 % 3001).alias("doc_id"), F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))).alias("ordinal"))
    out = files.with_chunk_ids(chunked, key="doc_id")
    assert "windowspecdefinition(doc_id" not in _plan(out)
    rows = sorted((r["doc_id"], r["ordinal"], r["id"]) for r in out.collect())
    assert [r[2] for r in rows] == list(range(1, 6001))
    assert files.with_chunk_ids(chunked.limit(0), key="doc_id").count() == 0


def test_dense_searches_vectors_without_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [0.8, 0.6])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r["id"] for r in catalog.QUERIES["dense_topk"](spark, str(tmp_path)).orderBy("rank").collect()] == [1, 9, 2]
