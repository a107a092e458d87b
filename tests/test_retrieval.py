import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.operators import lexical, nearest, passages, retrieval

WORDS = [f"w{i}" for i in range(60)] + ["词语", "词", "語言模型"]


def corpus(seed, n=400):
    rng = random.Random(seed)
    docs = [(i, " ".join(WORDS[int(len(WORDS) * rng.random() ** 3)] for _ in range(rng.randrange(0, 80)))) for i in range(n)]
    return docs + [(900, None), (901, "!!"), (None, "w0 w1"), (7, "w0 w0 w1"), (8, docs[20][1]), (9, docs[20][1])]


def plain(docs, asked, most):
    tokens = [(i, Counter(text.tokens_of(t or ""))) for i, t in docs]
    n, avg = len(docs), sum(sum(c.values()) for _, c in tokens) / len(docs)
    df = Counter(t for _, c in tokens for t in c)
    out = {}
    for q, words in asked.items():
        scored = []
        for i, c in tokens:
            hit = [t for t in set(text.tokens_of(words)) if c[t]]
            if hit and i is not None:
                scored.append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in hit), 9), i))
        out[q] = [i for _, i in sorted(scored)[:most]]
    return out


@pytest.mark.parametrize("segment, block, together, few", [(1 << 20, 128, 1024, 2048), (300, 4, 3, 8)])
def test_terms_against_plain_sums(spark, monkeypatch, segment, block, together, few):
    for name, value in (("SEGMENT", segment), ("BLOCK", block), ("TOGETHER", together), ("FEW", few)):
        monkeypatch.setattr(lexical, name, value)
    docs, rng = corpus(1), random.Random(2)
    asked = {i: " ".join(rng.sample(WORDS, 8) + ["w0", "nowhere"]) for i in range(11)} | {50: "", 51: "nowhere", 52: None}
    index = lexical.index_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    for most in (1, 7, 1000):
        got = {}
        for r in lexical.ranked_terms(index, queries, most).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {q: ids for q, ids in plain(docs, {q: t or "" for q, t in asked.items()}, most).items() if ids}
    assert lexical.ranked_terms(index, queries, 0).count() == 0
    with pytest.raises(ValueError):
        lexical.segments(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_tokens_of_a_batch_are_those_of_each_text():
    """Sliced arrays, empty and null texts, texts that touch, and CJK beside letters that only look alike."""
    odd = ["ab", "cd1", "", None, "中文字 abc", "É Ünï 9x", "ſ K İ ß", "字", "かな漢字カナ", "ABC㐀䶿def", "豈﫿 ", "---", "x" * 5000, "😀a😀B", "ａｂｃ １２", "", "Z"]
    rng = random.Random(8)
    texts = [rng.choice(odd) for _ in range(400)]
    whole = pa.array(texts, pa.string())
    for begin, n in ((0, 400), (13, 300), (399, 1), (5, 0)):
        terms, owner = lexical.batch_tokens(whole.slice(begin, n))
        got = [[] for _ in range(n)]
        for term, i in zip(terms.to_pylist(), owner.tolist(), strict=True):
            got[i].append(term)
        assert got == [text.tokens_of(t or "") for t in texts[begin : begin + n]]


def test_a_search_reads_the_terms_of_the_index_once(spark):
    index = lexical.index_of(spark.createDataFrame(corpus(1), "doc_id long, text string"))
    found = lexical.ranked_terms(index, spark.createDataFrame([(1, "w0 w1")], "query_id long, query string"), 5)
    path = index.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and path in line]
    assert len(scans) == 1 and "IsNull(term)" in scans[0]  # what is left to read are the heads of segments


def test_blocks_are_skipped():
    """Blocks that cannot reach the k-th score are not read, and nothing changes by it."""
    rng = np.random.default_rng(3)
    n = 20_000
    lengths = rng.integers(50, 400, n).astype(np.int32)
    docs = [np.sort(rng.choice(n, size, replace=False)).astype(np.int32) for size in (15_000, 12_000, 9_000, 300, 120, 40)]
    counts = [rng.geometric(0.6, len(d)).astype(np.int32) for d in docs]
    idf = np.array([np.log(1 + (n - len(d) + 0.5) / (len(d) + 0.5)) for d in docs])
    postings = lexical.Postings(lengths, docs, counts, idf, lengths.mean())
    found, score = postings.best(list(range(6)), 10)
    whole = np.zeros(n)
    for d, w in zip(docs, postings.weights):
        whole[d] += w
    assert found.tolist() == np.lexsort((np.arange(n), -np.round(whole, 9)))[:10].tolist() and np.allclose(score, whole[found])
    assert postings.read < 0.75 * postings.blocks


def test_sums_of_a_segment_are_those_of_its_blocks(monkeypatch):
    """The same documents and the same scores to the last bit, ties and fewer hits than asked included."""
    rng = np.random.default_rng(4)
    n = 3_000
    lengths = rng.choice([50, 80], n).astype(np.int32)
    docs = [np.sort(rng.choice(n, size, replace=False)).astype(np.int32) for size in (2_500, 900, 400, 3)]
    counts = [rng.integers(1, 3, len(d)).astype(np.int32) for d in docs]
    idf = np.array([np.log(1 + (n - len(d) + 0.5) / (len(d) + 0.5)) for d in docs])
    whole = lexical.Postings(lengths, docs, counts, idf, lengths.mean())
    monkeypatch.setattr(lexical, "WHOLE", 0)
    blocks = lexical.Postings(lengths, docs, counts, idf, lengths.mean())
    monkeypatch.setattr(lexical, "WHOLE", n)
    for terms in ([0, 1, 2, 3], [2, 1], [3]):
        for k in (1, 10, 200, 5_000):
            found = whole.best(terms, k)
            with monkeypatch.context() as m:
                m.setattr(lexical, "WHOLE", 0)
                want = blocks.best(terms, k)
            assert found[0].tolist() == want[0].tolist() and found[1].tolist() == want[1].tolist()
    assert whole.blocks == 0 and not whole.order and blocks.blocks > 0  # no block is sorted or met where all is summed


def test_index_of_files_reads_what_has_changed(spark, tmp_path):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string")
    source, folder = f"{tmp_path}/docs", f"{tmp_path}/index"
    for k in range(3):
        docs.filter(F.coalesce("doc_id", F.lit(0)) % 3 == k).coalesce(1).write.parquet(f"{source}/part={k}")
    queries = spark.createDataFrame([(1, "w0 w3 w20"), (2, "词语 w5")], "query_id long, query string")
    index = lambda: lexical.FileIndex(spark, f"{source}/*", folder=folder)
    ranks = lambda rows: sorted(map(tuple, lexical.ranked_terms(rows, queries, 20).select("query_id", "id", "rank", F.round("score", 9)).collect()))
    anew = lambda: ranks(lexical.index_of(spark.read.parquet(*(f"{source}/part={k}" for k in range(3)))))
    one = index()
    assert ranks(one.refresh()) == anew() and len(one.scanned) == 3
    two = index()
    rows = two.refresh()
    assert two.scanned == [] and ranks(rows) == anew()  # no text is read again
    spark.createDataFrame([(5000, "w0 w3 w3 w20 w20"), (5001, "w59")], docs.schema).coalesce(1).write.mode("overwrite").parquet(f"{source}/part=1")
    three = index()
    rows = three.refresh()
    assert len(three.scanned) == 1 and "part=1" in three.scanned[0]
    assert ranks(rows) == anew() and (1, 5000) in {r[:2] for r in ranks(rows)}
    assert {r["n_docs"] for r in lexical.corpus_stats(rows).collect()} == {spark.read.parquet(source).count()}
    spark.createDataFrame([], docs.schema).coalesce(1).write.mode("overwrite").parquet(f"{source}/part=1")
    four = index()
    assert ranks(four.refresh()) == anew() and lexical.corpus_stats(four.refresh()).first()["n_docs"] == spark.read.parquet(source).count()


@pytest.mark.parametrize("few", [True, False])
def test_nearest_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 4)
    if not few:
        monkeypatch.setattr(nearest, "MOST_BROADCAST_ROWS", 2)
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(150, 6)), 0)  # many ties
    rows = spark.createDataFrame([(int(i * 37 % 150), v[i].tolist()) for i in range(150)] + [(1000, None)], "id long, v array<float>").repartition(4)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(11)] + [(99, None)], "query_id long, q array<double>")
    by_id = {i * 37 % 150: v[i] for i in range(150)}
    want = {}
    for q in range(11):
        order = sorted((-float(v[q] @ x), i) for i, x in by_id.items())[:7]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(order)}
    found = retrieval.dense(rows, asked, 7)
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.dense(rows, asked, 0).count() == 0 == retrieval.dense(rows.limit(0), asked).count()
    with pytest.raises(Exception, match="numbers"):
        retrieval.dense(rows, spark.createDataFrame([(1, [1.0])], asked.schema)).collect()


@pytest.mark.parametrize("most", [50_000, 2])
def test_passages_against_contains(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "MOST_PASSAGES", most)
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abé词 ") for _ in range(rng.randrange(0, 300)))) for i in range(60)] + [(60, None), (61, ""), (5, "abab")]
    items = [(100 + i, "".join(rng.choice("abé词 ") for _ in range(rng.randrange(1, 5)))) for i in range(20)] + [(1, "ab"), (2, "abab"), (3, "ab"), (4, None), (5, "b")]
    for extra in ([], [(6, "")]):
        asked = items + extra
        df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, query string")
        got = passages.holding(df, spark.createDataFrame(asked, "query_id long, query string"))
        assert sorted(map(tuple, got.collect())) == sorted((q, d) for d, t in texts if t is not None for q, p in asked if p is not None and p in t)
    empty = spark.createDataFrame([], "query_id long, query string")
    assert passages.holding(df, empty).count() == 0


def test_search_finds_documents_without_vectors(spark):
    chunks = spark.createDataFrame([(1, "red fish", "s", [1.0, 0.0]), (2, "red bird", "s", None), (3, "blue", "t", [0.0, 1.0])], "id long, text string, source string, embedding array<double>")
    queries = spark.createDataFrame([(1, "bird", [1.0, 0.0])], "query_id long, query string, q array<double>")
    got = {r["id"]: (r["score"], r["dense_rank"]) for r in retrieval.search(chunks, queries, "hybrid", 5).collect()}
    assert got == {1: (1.0, 1), 2: (None, None), 3: (0.0, 2)}


def test_scorer_is_loaded_once_and_its_failure_sticks(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with log.open("a") as f:
            f.write("x")

        def model(pairs):
            if any("bad" in text for _, text in pairs):
                raise RuntimeError("no more")
            return [float(len(text)) - 5 for _, text in pairs]

        return model

    score = retrieval.loaded_scorer(load, batch=4)
    rows = spark.createDataFrame([(i, "q", "y" * (i * 7 % 23)) for i in range(40)], "i int, q string, t string").coalesce(1)
    got = {r["i"]: r["s"] for r in rows.select("i", score("q", "t").alias("s")).collect()}
    assert all(s == pytest.approx(1 / (1 + math.exp(5 - i * 7 % 23))) for i, s in got.items())  # in the rows' order, whatever that of the batches
    assert log.read_text() == "x"
    failing = retrieval.loaded_scorer(load, batch=1)
    rows = spark.createDataFrame([(1, "q", "a"), (2, "q", "bad"), (3, "q", "longer than that")], "i int, q string, t string").coalesce(1)
    got = {r["i"]: r["s"] for r in rows.select("i", failing("q", "t").alias("s")).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None  # by length: the third comes after the failure

    def broken():
        raise OSError("no model")

    none = retrieval.loaded_scorer(broken)
    assert [r["s"] for r in rows.select(none("q", "t").alias("s")).collect()] == [None] * 3


def test_a_failed_score_leaves_the_query_in_its_order(spark):
    base = spark.createDataFrame([(q, i, i) for q in (1, 2) for i in range(1, 5)], "query_id long, id long, rank int")
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 2, None), (1, 3, 0.9), (2, 1, 0.1), (2, 2, 0.5), (2, 3, 0.9)], "query_id long, id long, rerank_score double")
    got = retrieval.reranked(base, scores, 3).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4, 3, 2, 1, 4]
    assert [r["rerank_score"] for r in got] == [None] * 4 + [0.9, 0.5, 0.1, None]
