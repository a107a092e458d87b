"""Queries of the engine over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import calculators as calc
from loomwork.functions import scalars, text, vectors
from loomwork.functions.vectors import dot
from loomwork.operators import evaluation, golden, lexical, matching, passages, retrieval, usage
from loomwork.sources import files, rules, tables
from loomwork.sources.shared import shared_path, small, stored
from loomwork.streaming.token_bucket import run_to_end, token_bucket_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- retrieval

_TOKENS = (
    "flatten(list_transform(regexp_extract_all({0}, '[㐀-䶿一-鿿豈-﫿]+|[A-Za-z0-9]+'), "
    "lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN [lower(r)] WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i : i + 1]) END))"
)
_BM25 = f"""
toks AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS t FROM documents),
tot AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM toks),
asked AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS.format("text")})) AS term FROM benchmark),
posted AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM posted WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bscore AS (
  SELECT query_id, doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), tot GROUP BY ALL),
brank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bscore),
vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
qvec AS (SELECT item_id AS query_id, v AS q FROM benchmark JOIN vec ON id = item_id),
dscore AS (SELECT query_id, id, list_dot_product(q, v) AS score FROM qvec, vec),
drank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM dscore),
fscore AS (
  SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score
  FROM (SELECT query_id, id, rank FROM brank WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM drank WHERE rank <= 50) GROUP BY ALL),
frank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fscore)"""
_GOLD = """
gold AS (SELECT item_id AS query_id, list(doc_id ORDER BY doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
sized AS (SELECT query_id, gold, CASE WHEN len(gold) > 1 THEN 'many' ELSE 'one' END AS category FROM gold)"""
_ROWS = """
rrows AS (
  SELECT s.query_id, s.category, s.gold, m.mode,
    min(CASE WHEN list_contains(s.gold, r.id) THEN r.rank END) AS first_rank,
    coalesce(list(r.id ORDER BY r.rank) FILTER (r.id IS NOT NULL), []) AS ranked
  FROM sized s CROSS JOIN (VALUES ('dense'), ('bm25'), ('hybrid')) m(mode)
  LEFT JOIN (
    SELECT 'dense' AS mode, query_id, id, rank FROM drank WHERE rank <= 50 UNION ALL SELECT 'bm25', query_id, id, rank FROM brank WHERE rank <= 50
    UNION ALL SELECT 'hybrid', query_id, id, rank FROM frank WHERE rank <= 50) r ON r.query_id = s.query_id AND r.mode = m.mode
  GROUP BY s.query_id, s.category, s.gold, m.mode)"""


_TO_100 = lambda sql: sql.strip().replace("rank <= 50", "rank <= 100")


def _recalls(k: int = 5) -> str:
    cells = [f"avg(len(list_intersect(gold, ranked[1:{n}])) / len(gold)) AS recall_{n}, avg(CASE WHEN first_rank <= {n} THEN 1.0::DOUBLE ELSE 0 END) AS hit_{n}" for n in evaluation.KS]
    return (
        "count(*) AS n, " + ", ".join(cells) + f", avg(CASE WHEN first_rank <= {k} THEN 1.0::DOUBLE / first_rank ELSE 0 END) AS mrr_{k}, avg(CASE WHEN first_rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1_share, "
        f"avg(CASE WHEN first_rank BETWEEN 2 AND {k} THEN 1.0::DOUBLE ELSE 0 END) AS rank2_{k}_share, count(*) FILTER (first_rank IS NULL) AS misses"
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the documents' files, made by the first query that asks for it and kept for the others."""
    return lexical.FileIndex(spark, f"{sf_dir}/documents.parquet").refresh()


def _all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return _all_vectors(spark, sf_dir).join(ids, "id", "left_semi")


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select(F.col("query_id").alias("id"))
    return _vectors(spark, sf_dir).join(items, "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def _routes(spark: SparkSession, sf_dir: str, most: int = 50) -> dict[str, DataFrame]:
    """The first `most` rows of each route, each worked out once, and their fusion."""
    by_terms = stored(retrieval.ranked_terms(_index(spark, sf_dir), _items(spark, sf_dir), most), "terms")
    by_vector = stored(retrieval.dense(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), most), "dense")
    return {"dense": by_vector, "bm25": by_terms, "hybrid": retrieval.fused([by_vector, by_terms], most)}


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, gold, category: the documents that hold a benchmark passage."""
    pairs = passages.holding(_table(spark, sf_dir, "documents"), _items(spark, sf_dir))
    found = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("gold"))
    return stored(found.withColumn("category", F.when(F.size("gold") > 1, "many").otherwise("one")), "gold")


def _all_rows(spark: SparkSession, sf_dir: str, pool: int = 50, most: int | None = None) -> DataFrame:
    """Rows of every mode: routes and fusion of `pool` rows, of which the first `most` (all if None) count."""
    gold, out = _gold(spark, sf_dir), None
    for mode, ranked in _routes(spark, sf_dir, pool).items():
        rows = evaluation.retrieval_rows(ranked, gold, pool if most is None else most).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_BM25.strip()} SELECT query_id, id, rank, round(score, 6) AS score FROM brank WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    found = retrieval.ranked_terms(_index(spark, sf_dir), _items(spark, sf_dir), 10)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(
    f"WITH t AS (SELECT {_TOKENS.format("coalesce(text, '')")} AS t FROM documents) "
    "SELECT count(*) AS n_docs, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM t)) AS n_terms, CAST(sum(len(t)) AS BIGINT) AS n_tokens, sum(len(t)) / count(*) AS avgdl FROM t"
)
def bm25_corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_index(spark, sf_dir))


@query(
    "WITH vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT item_id AS query_id, v AS q FROM benchmark JOIN vec ON id = item_id), "
    "r AS (SELECT query_id, id, list_dot_product(q, v) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, v), 9) DESC, id) AS rank FROM q, vec) "
    "SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"
)
def dense_topk(spark, sf_dir):
    """Every embedding, with and without a document, for the vectors whose ids are those of benchmark items."""
    every = _all_vectors(spark, sf_dir)
    asked = every.join(_items(spark, sf_dir).select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.dense(every, asked, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25.strip()} SELECT query_id, id, rank, round(score, 9) AS score FROM frank WHERE rank <= 20")
def hybrid_rrf(spark, sf_dir):
    found = _routes(spark, sf_dir)["hybrid"].filter("rank <= 20")
    return found.select("query_id", "id", "rank", F.round("score", 9).alias("score"))


_OVERLAP = f"""
pool AS (SELECT f.query_id, f.id, f.rank, f.score, b.text AS qt, d.text AS dt FROM frank f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.id WHERE f.rank <= 50),
olap AS (
  SELECT query_id, id, rank AS base_rank, coalesce(len(list_intersect(list_distinct({_TOKENS.format("qt")}), list_distinct({_TOKENS.format("dt")}))) / nullif(len(list_distinct({_TOKENS.format("qt")})), 0), 0) AS rerank_score
  FROM pool)"""


def _rerank_pool(spark, sf_dir):
    hybrid = _routes(spark, sf_dir)["hybrid"].select("query_id", "id", "rank")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    joined = hybrid.join(docs, "id").join(small(_items(spark, sf_dir)), "query_id")
    return hybrid, joined.select("query_id", "id", "rank", retrieval.overlap_score(F.col("query"), F.col("text")).alias("rerank_score"))


@query(
    f"WITH {_BM25.strip()}, {_OVERLAP.strip()} SELECT query_id, id, base_rank, "
    "row_number() OVER (PARTITION BY query_id ORDER BY base_rank > 20, CASE WHEN base_rank <= 20 THEN -round(rerank_score, 9) END, base_rank) AS rank FROM olap"
)
def rerank_partial_sort(spark, sf_dir):
    base, scored = _rerank_pool(spark, sf_dir)
    return retrieval.reranked(base, scored, 20).select("query_id", "id", "base_rank", "rank")


@query(
    f"""WITH {_TO_100(_BM25)}, {_OVERLAP.strip().replace("f.rank <= 50", "f.rank <= 100")},
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base_rank > 10, CASE WHEN base_rank <= 10 THEN -round(rerank_score, 9) END, base_rank) AS rank FROM olap WHERE query_id IN (SELECT query_id FROM qvec))
SELECT p.query_id, p.id, p.rank, round(d.score, 6) AS score, CASE WHEN d.rank <= 100 THEN d.rank END AS dense_rank, CASE WHEN base_rank <= 10 THEN base_rank END AS rerank_rank
FROM placed p LEFT JOIN drank d USING (query_id, id) WHERE p.rank <= 5"""
)
def search_hybrid_rerank(spark, sf_dir):
    """Over all documents; those without a vector are found by their terms and have no cosine."""
    chunks, asked = _chunks(spark, sf_dir)
    found = retrieval.search(chunks, asked, "hybrid+rerank10", 5, index=_index(spark, sf_dir))
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "dense_rank", "rerank_rank")


_CUT = "array_to_string(string_split(d.text, ' ')[1 : greatest(0, 512 - len(string_split(b.text, ' ')))], ' ')"


@query(
    f"WITH {_BM25.strip()}, {_OVERLAP.strip().replace('d.text AS dt', _CUT + ' AS dt')} SELECT query_id, id, base_rank, CASE WHEN base_rank <= 20 THEN round(1 / (1 + exp(4 - 8 * rerank_score)), 6) END AS rerank_score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY base_rank > 20, CASE WHEN base_rank <= 20 THEN -round(1 / (1 + exp(4 - 8 * rerank_score)), 9) END, base_rank) AS rank FROM olap"
)
def rerank_by_model(spark, sf_dir):
    """The pool re-ranked by a scorer that each worker loads once; its stand-in model has logits from the share of the query's terms."""

    def load():
        from loomwork.functions.text import tokens_of

        def share(query, words):
            asked = set(tokens_of(query))
            return len(asked & set(tokens_of(words))) / len(asked) if asked else 0.0

        return lambda pairs: [8 * share(*pair) - 4 for pair in pairs]

    hybrid = stored(_routes(spark, sf_dir)["hybrid"].select("query_id", "id", "rank"), "hybrid")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    joined = hybrid.filter("rank <= 20").join(docs, "id").join(small(_items(spark, sf_dir)), "query_id")
    scored = joined.select("query_id", "id", retrieval.loaded_scorer(load)(F.col("query"), F.col("text")).alias("rerank_score"))
    return retrieval.reranked(hybrid, scored, 20).select("query_id", "id", "base_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def _chunks(spark, sf_dir):
    """All documents, with vectors where they have them, and the items that have one."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    vectors = _all_vectors(spark, sf_dir).withColumnRenamed("v", "embedding")
    return docs.join(vectors, "id", "left"), _items(spark, sf_dir).join(_query_vectors(spark, sf_dir), "query_id")


_PROMPT = [part.replace("%%", "%").replace("'", "''") for part in text.ANSWER_PROMPT.split("%s")]


@query(
    f"""WITH {_BM25.strip()}, top AS (SELECT query_id, rank, source, text FROM drank JOIN documents ON doc_id = id WHERE rank <= 5),
c AS (SELECT query_id, string_agg('【' || source || '】' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY query_id),
o AS (SELECT query_id, list(source ORDER BY r) AS sources FROM (SELECT query_id, source, min(rank) AS r FROM top GROUP BY ALL) GROUP BY query_id)
SELECT query_id, context, '{_PROMPT[0]}' || context || '{_PROMPT[1]}' AS prompt, sources FROM c JOIN o USING (query_id)"""
)
def ask_prompts(spark, sf_dir):
    chunks, asked = _chunks(spark, sf_dir)
    return retrieval.ask_prompts(retrieval.search(chunks, asked, "dense", 5))


@query(
    f"""SELECT c_custkey AS request_id, '{text.PROMPT_VERSIONS["recipe"]}' AS version, CASE WHEN c_custkey % 2 = 0 THEN '{text.RECIPE_PROMPT}' ELSE '{text.PLAN_PROMPT}' END AS system,
  CASE WHEN c_custkey % 2 = 0 THEN '{{"calories":' || (1200 + c_custkey % 40 * 50) || ',"goal":"cut"}}' ELSE '{{"muscleGroup":"back","level":"beginner"}}' END AS user FROM customer"""
)
def provider_prompts(spark, sf_dir):
    """The system and user messages of recipe and plan requests."""
    k = F.col("c_custkey")
    recipe = text.request_prompt("recipe", F.struct((1200 + k % 40 * 50).alias("calories"), F.lit("cut").alias("goal")))
    plan = text.request_prompt("plan", F.struct(F.lit("back").alias("muscleGroup"), F.lit("beginner").alias("level")))
    return _table(spark, sf_dir, "customer").select(k.alias("request_id"), F.when(k % 2 == 0, recipe).otherwise(plan).alias("p")).select("request_id", "p.*")


@query(
    f"""WITH a AS ({ORACLES["ask_prompts"]}) SELECT query_id, '{text.PROMPT_VERSIONS["judge"]}' AS version,
  '【文档片段】' || chr(10) || context || chr(10) || chr(10) || '【用户问题】' || chr(10) || b.text || chr(10) || chr(10) || '【系统回答】' || chr(10) || sources[1] AS user FROM a JOIN benchmark b ON item_id = query_id"""
)
def judge_prompts(spark, sf_dir):
    """The judge's user messages for the answers to the benchmark items, whose text is the first source here."""
    asked = ask_prompts(spark, sf_dir).join(small(_items(spark, sf_dir)), "query_id")
    user = text.judge_prompt(F.col("query"), F.col("sources")[0], F.col("context"))
    return asked.select("query_id", F.lit(text.PROMPT_VERSIONS["judge"]).alias("version"), user.alias("user"))


# ---------------------------------------------------------------- chunking

_STRIPPED = r"regexp_replace({0}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+$', '', 'g')"
_CLEAN = (
    r"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10) || chr(10)), "
    r"lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda l: " + _STRIPPED.format("l").replace("{", "{{").replace("}", "}}") + "), lambda l: l <> ''), chr(10))), lambda p: p <> ''), chr(10) || chr(10))"
)


@query(
    f"""WITH c AS (SELECT doc_id, {_CLEAN.format("text")} AS p FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, p, CASE WHEN length(p) < 500 THEN 0 ELSE CAST(floor((length(p) - 500) / 350) AS BIGINT) + 1 END AS last FROM c WHERE length(p) >= 24),
o AS (SELECT doc_id, p, CASE WHEN length(p) <= 400 THEN 0 ELSE last END AS last, unnest(range(0, CASE WHEN length(p) <= 400 THEN 1 ELSE last + 1 END)) AS ordinal FROM k)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, 'chunk-' || ordinal AS meta, substr(p, ordinal * 350 + 1, CASE WHEN ordinal = last THEN length(p) ELSE 400 END) AS text FROM o"""
)
def chunk_documents(spark, sf_dir):
    """Documents hold no blank lines, so each is one paragraph."""
    return files.chunk_table(_table(spark, sf_dir, "documents"), key="doc_id")


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, list_filter(string_split({_CLEAN.format("text")}, chr(10) || chr(10)), lambda p: p <> '') AS ps FROM t WHERE text IS NOT NULL),
f AS (
  SELECT conv_id, ps, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS held FROM c
  UNION ALL
  SELECT conv_id, ps, i + 1, CASE WHEN length(j) >= 120 THEN list_append(done, j) ELSE done END, CASE WHEN length(j) >= 120 THEN '' ELSE j END
  FROM (SELECT *, CASE WHEN held = '' THEN ps[i + 1] ELSE held || chr(10) || ps[i + 1] END AS j FROM f WHERE i < len(ps))),
e AS (
  SELECT conv_id, CASE WHEN held = '' THEN done WHEN len(done) > 0 THEN list_append(done[1 : len(done) - 1], done[len(done)] || chr(10) || held) WHEN length(held) >= 24 THEN [held] ELSE [] END AS m
  FROM f WHERE i = len(ps)),
p AS (SELECT conv_id, unnest(m) AS p, unnest(range(len(m))) AS k FROM e),
w AS (SELECT conv_id, k, p, CASE WHEN length(p) <= 400 OR length(p) < 500 THEN 0 ELSE CAST(floor((length(p) - 500) / 350) AS BIGINT) + 1 END AS last FROM p),
o AS (SELECT conv_id, k, p, last, unnest(range(0, last + 1)) AS n FROM w),
x AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, n) - 1 AS INTEGER) AS ordinal, substr(p, n * 350 + 1, CASE WHEN n = last THEN length(p) ELSE 400 END) AS text FROM o)
SELECT conv_id, ordinal, 'chunk-' || ordinal AS meta, text FROM x"""
)
def chunk_merge_short(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    return files.chunk_table(joined, key="conv_id")


@query(
    f"""WITH c AS (SELECT doc_id, {_CLEAN.format("text")} AS p FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, CASE WHEN length(p) < 24 THEN 0 WHEN length(p) <= 400 OR length(p) < 500 THEN 1 ELSE CAST(floor((length(p) - 500) / 350) AS BIGINT) + 2 END AS n FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY doc_id) - n + 1 AS BIGINT) AS first_id FROM n WHERE n > 0"""
)
def chunk_ids(spark, sf_dir):
    rows = files.with_chunk_ids(files.chunk_table(_table(spark, sf_dir, "documents"), key="doc_id"), key="doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# ---------------------------------------------------------------- evaluation


@query(f"WITH {_TO_100(_BM25)}, {_GOLD.strip()}, {_TO_100(_ROWS)} SELECT mode, {_recalls()} FROM rrows GROUP BY mode")
def retrieval_metrics(spark, sf_dir):
    """The curve's pool is as deep as its largest k."""
    return evaluation.retrieval_metrics(_all_rows(spark, sf_dir, max(evaluation.KS)), ("mode",))


@query(f"WITH {_TO_100(_BM25)}, {_GOLD.strip()}, {_TO_100(_ROWS)} SELECT mode, category, {_recalls()} FROM rrows GROUP BY mode, category")
def metrics_by_group(spark, sf_dir):
    return evaluation.retrieval_metrics(_all_rows(spark, sf_dir, max(evaluation.KS)), ("mode", "category"))


@query(
    f"WITH {_BM25.strip()}, {_GOLD.strip()}, {_ROWS.strip()} SELECT mode, count(*) AS n, avg(CASE WHEN first_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_recall, "
    "round(avg(CASE WHEN first_rank <= 5 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 9) AS mrr, avg(CASE WHEN first_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS pool_recall, "
    "round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 9) AS pool_mrr FROM rrows GROUP BY mode"
)
def production_metrics(spark, sf_dir):
    """The first 5 of a pool of 50 a route, as production serves them, and the whole pool of 50."""
    found = evaluation.production_metrics(_all_rows(spark, sf_dir, retrieval.CANDIDATES), ("mode",), page=5)
    return found.withColumns({c: F.round(c, 9) for c in ("mrr", "pool_mrr")})


@query(
    f"WITH {_BM25.strip()}, {_GOLD.strip()}, {_ROWS.strip().replace('rank <= 50', 'rank <= 5')} SELECT mode, count(*) AS n, avg(CASE WHEN first_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS hit_recall, "
    "round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 9) AS mrr FROM rrows GROUP BY mode"
)
def served_metrics(spark, sf_dir):
    """What is served: the first 5 of pools of 50."""
    return production_metrics(spark, sf_dir).select("mode", "n", "hit_recall", "mrr")


@query(
    f"""WITH {_BM25.strip()}, {_GOLD.strip()}, {_ROWS.strip()}, h AS (SELECT query_id, mode, coalesce(first_rank <= 5, false) AS h FROM rrows)
SELECT a.mode AS mode_a, b.mode AS mode_b, count(*) FILTER (a.h AND b.h) AS both, count(*) FILTER (a.h AND NOT b.h) AS only_a, count(*) FILTER (NOT a.h AND b.h) AS only_b,
  count(*) FILTER (NOT a.h AND NOT b.h) AS neither, count(*) FILTER (a.h OR b.h) AS either
FROM h a JOIN h b USING (query_id) WHERE (a.mode, b.mode) IN (('dense', 'bm25'), ('dense', 'hybrid'), ('bm25', 'hybrid')) GROUP BY a.mode, b.mode"""
)
def mode_contingency(spark, sf_dir):
    return evaluation.mode_contingency(_all_rows(spark, sf_dir), ["dense", "bm25", "hybrid"])


@query(
    f"WITH {_BM25.strip()}, {_GOLD.strip()}, {_ROWS.strip()}, o AS (SELECT query_id, bool_or(coalesce(first_rank <= 5, false)) AS f FROM rrows GROUP BY query_id) SELECT count(*) AS n, count(*) FILTER (f) AS found FROM o"
)
def oracle_ceiling(spark, sf_dir):
    return evaluation.oracle_ceiling(_all_rows(spark, sf_dir))


@query(
    f"""WITH {_BM25.strip()}, {_GOLD.strip()}, {_ROWS.strip()},
m AS (SELECT mode, list_position(['dense', 'bm25', 'hybrid'], mode) AS ord, avg(CASE WHEN first_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_5 FROM rrows GROUP BY mode)
SELECT mode, hit_5, round(hit_5 - lag(hit_5) OVER (ORDER BY ord), 9) AS delta FROM m"""
)
def mode_delta(spark, sf_dir):
    metrics = evaluation.retrieval_metrics(_all_rows(spark, sf_dir), ("mode",)).withColumn("ord", F.array_position(F.array(*map(F.lit, ("dense", "bm25", "hybrid"))), F.col("mode")))
    return evaluation.mode_delta(metrics, "hit_5").select("mode", "hit_5", F.round("delta", 9).alias("delta"))


_DEPTHS, _FUSION_DEPTHS = [5, 10, 20, 50], [20, 50, 100, 200]


@query(
    f"""WITH {_BM25.strip()}, {_GOLD.strip()}, dep AS (SELECT unnest([20, 50, 100, 200]) AS depth),
fd AS (
  SELECT depth, query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score
  FROM (SELECT query_id, id, rank FROM brank WHERE rank <= 200 UNION ALL SELECT query_id, id, rank FROM drank WHERE rank <= 200) JOIN dep ON rank <= depth GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY depth, query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fd),
c AS (SELECT g.query_id, dep.depth, min(fr.rank) AS r FROM gold g CROSS JOIN dep LEFT JOIN fr ON fr.query_id = g.query_id AND fr.depth = dep.depth AND fr.rank <= dep.depth AND list_contains(g.gold, fr.id) GROUP BY ALL),
b AS (SELECT query_id, r AS b FROM c WHERE depth = 20)
SELECT depth, count(*) AS n, avg(CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS in_pool_share, avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_5,
  avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE / r ELSE 0 END) AS mrr_5, avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1_share, count(*) FILTER (r IS NULL) AS misses, count(*) FILTER (r IS DISTINCT FROM b) AS n_changed
FROM c JOIN b USING (query_id) GROUP BY depth"""
)
def fusion_depth_sweep(spark, sf_dir):
    """Fused anew at each depth."""
    routes = _routes(spark, sf_dir, max(_FUSION_DEPTHS))
    fused = retrieval.fused_at([routes["dense"], routes["bm25"]], _FUSION_DEPTHS)
    return evaluation.depth_metrics(evaluation.depth_rows(fused, _gold(spark, sf_dir), _FUSION_DEPTHS))


@query(
    f"""WITH {_BM25.strip()}, {_GOLD.strip()}, {_OVERLAP.strip()},
p AS (
  SELECT o.query_id, o.id, depth, row_number() OVER (PARTITION BY query_id, depth ORDER BY base_rank > depth, CASE WHEN base_rank <= depth THEN -round(rerank_score, 9) END, base_rank) AS place
  FROM olap o CROSS JOIN (VALUES (5), (10), (20), (50)) d(depth)),
f AS (SELECT query_id, depth, min(CASE WHEN list_contains(gold, id) THEN place END) AS r FROM p JOIN gold USING (query_id) GROUP BY query_id, depth)
SELECT depth, count(*) AS n, avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_5, avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE / r ELSE 0 END) AS mrr_5,
  avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1_share, count(*) FILTER (r IS NULL) AS misses, depth * 259.0::DOUBLE AS rerank_ms FROM f GROUP BY depth"""
)
def rerank_pool_curve(spark, sf_dir):
    _, scored = _rerank_pool(spark, sf_dir)
    return evaluation.rerank_pool_curve(scored, _gold(spark, sf_dir), _DEPTHS, 259.0)


_SAMPLES = """
s AS (
  SELECT doc_id AS id, i AS idx, CASE WHEN (doc_id + i) % 7 = 0 THEN NULL ELSE (doc_id * 3 + i * 2 + quality) % 5 + 1 END AS faithfulness,
    CASE WHEN (doc_id + i) % 7 = 0 THEN NULL ELSE (doc_id + i * toxic + 1) % 5 + 1 END AS relevance,
    CASE WHEN (doc_id + i) % 7 = 0 THEN NULL ELSE (doc_id * i + 2) % 5 + 1 END AS sufficiency, 'sample ' || i AS reasoning
  FROM labels CROSS JOIN (VALUES (0), (1), (2)) v(i))"""


def _samples(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").withColumn("idx", F.explode(F.array(*map(F.lit, range(3)))))
    i, d = F.col("idx"), F.col("doc_id")
    score = lambda x: F.when((d + i) % 7 != 0, x % 5 + 1)
    axes = (score(d * 3 + i * 2 + F.col("quality")), score(d + i * F.col("toxic") + 1), score(d * i + 2))
    return labels.select(d.alias("id"), "idx", *(x.alias(n) for x, n in zip(axes, evaluation.AXES, strict=True)), F.concat(F.lit("sample "), i.cast("string")).alias("reasoning"))


_JUDGED = (
    _SAMPLES
    + """,
m AS (SELECT id, median(faithfulness) AS f, median(relevance) AS r, median(sufficiency) AS u, count(faithfulness) AS n_ok FROM s GROUP BY id),
j AS (
  SELECT s.id, f, r, u, n_ok, min_by(reasoning, [abs(faithfulness - f) + abs(relevance - r) + abs(sufficiency - u), idx]) FILTER (faithfulness IS NOT NULL) AS reasoning
  FROM s JOIN m USING (id) GROUP BY s.id, f, r, u, n_ok),
judged AS (
  SELECT id, CASE WHEN n_ok >= 2 THEN f END AS faithfulness, CASE WHEN n_ok >= 2 THEN r END AS relevance, CASE WHEN n_ok >= 2 THEN u END AS sufficiency,
    CASE WHEN n_ok >= 2 THEN reasoning END AS reasoning, n_ok, n_ok < 2 AS failed FROM j)"""
)


@query(f"WITH {_JUDGED.strip()} SELECT * FROM judged")
def judge_aggregate(spark, sf_dir):
    return evaluation.judge_aggregate(_samples(spark, sf_dir), 3)


@query(
    f"""WITH {_SAMPLES.strip()}, l AS (
  SELECT unnest(['faithfulness', 'relevance', 'sufficiency']) AS axis, unnest([faithfulness, relevance, sufficiency]) AS score FROM s)
SELECT a.axis, v.score, count(l.score) AS n FROM (VALUES ('faithfulness'), ('relevance'), ('sufficiency')) a(axis) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(score)
LEFT JOIN l ON l.axis = a.axis AND l.score = v.score GROUP BY a.axis, v.score"""
)
def answer_summary(spark, sf_dir):
    return evaluation.answer_summary(_samples(spark, sf_dir))


@query(
    f"""WITH {_SAMPLES.strip()}, x AS (SELECT s.*, idx = 0 AS context_hit, (id * 37 + idx * 11) % 900 AS answer_ms FROM s)
SELECT context_hit, count(*) AS n, round(coalesce(avg(faithfulness), 0), 9) AS mean_faithfulness, round(coalesce(avg(relevance), 0), 9) AS mean_relevance, round(coalesce(avg(sufficiency), 0), 9) AS mean_sufficiency,
  coalesce(median(answer_ms) FILTER (answer_ms > 0), 0) AS median_ms FROM x GROUP BY context_hit"""
)
def answer_means(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("context_hit", F.col("idx") == 0).withColumn("answer_ms", (F.col("id") * 37 + F.col("idx") * 11) % 900)
    out = evaluation.answer_means(rows, ("context_hit",))
    return out.select("context_hit", "n", *(F.round(f"mean_{a}", 9).alias(f"mean_{a}") for a in evaluation.AXES), "median_ms")


@query(f"WITH {_SAMPLES.strip()}, k AS (SELECT id, count(DISTINCT sufficiency) AS k FROM s GROUP BY id) SELECT count(*) FILTER (k > 1) AS n_unstable FROM k")
def unstable_answers(spark, sf_dir):
    return evaluation.unstable(_samples(spark, sf_dir))


@query(
    f"WITH {_GOLD.strip()} SELECT g.query_id, list_min(g.gold) AS least, coalesce(d.source, '?') AS source FROM (SELECT query_id, gold FROM gold UNION ALL SELECT -1, [-5]) g LEFT JOIN documents d ON d.doc_id = list_min(g.gold)"
)
def gold_sources(spark, sf_dir):
    """The source of each item's smallest gold document; one item's gold is not there."""
    gold = _gold(spark, sf_dir).select("query_id", "gold").union(spark.createDataFrame([(-1, [-5])], "query_id long, gold array<long>"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return evaluation.gold_source(gold, docs).select("query_id", F.array_min("gold").alias("least"), "source")


@query(
    "SELECT event_type AS mode, median(event_id % 900) AS median_ms, median(CASE WHEN event_id % 4 <> 0 THEN event_id % 77 END) AS median_rerank_ms, round(avg(CAST(value AS DOUBLE)), 6) AS mean_top1_score FROM events WHERE event_type = 'click' GROUP BY event_type"
)
def latency_medians(spark, sf_dir):
    i = F.col("event_id")
    rows = _table(spark, sf_dir, "events").filter("event_type = 'click'").select((i % 900).alias("ms"), F.when(i % 4 != 0, i % 77).alias("rerank_ms"), F.col("value").alias("top1_score"))
    return evaluation.latency_summary(rows).select(F.lit("click").alias("mode"), "median_ms", "median_rerank_ms", F.round("mean_top1_score", 6).alias("mean_top1_score"))


@query(f"WITH {_JUDGED.strip()} SELECT id, faithfulness, relevance, sufficiency FROM judged WHERE NOT failed ORDER BY least(faithfulness, relevance, sufficiency), sufficiency, faithfulness, id LIMIT 20")
def worst_answers(spark, sf_dir):
    rows = evaluation.judge_aggregate(_samples(spark, sf_dir), 3).filter("not failed")
    return evaluation.worst_first(rows, 20).select("id", *evaluation.AXES)


@query("SELECT user_id, stddev_pop(event_id % 3) > 0.000001 AS varied FROM events GROUP BY user_id")
def score_dispersion(spark, sf_dir):
    return evaluation.dispersed(_table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("score")), "score", "user_id")


# ---------------------------------------------------------------- golden sets


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, source, turn, row_number() OVER (ORDER BY turn, source) AS place FROM r")
def golden_interleave(spark, sf_dir):
    """Every document, one of each source in turn."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return golden.interleaved(docs, key="doc_id", order=["doc_id"])


_POOL_TEXT = _STRIPPED.format("coalesce(text, '')")
_POOL_START = "^[A-Za-z一-鿿0-9（(“" + '"' + "]"


_ELIGIBLE = f"length({_POOL_TEXT}) >= 150 AND regexp_matches({_POOL_TEXT}, '{_POOL_START}') AND len(regexp_extract_all({_POOL_TEXT}, '[一-鿿]')) >= 37"


@query(f"SELECT doc_id, {_ELIGIBLE} AS long_enough FROM documents")
def golden_filter(spark, sf_dir):
    """Whether the question pool takes a document, by all its rules."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.eligible_for_questions(F.col("text")).alias("long_enough"))


@query(
    f"""SELECT doc_id, length({_POOL_TEXT}) >= 150 AND regexp_matches({_POOL_TEXT}, '{_POOL_START}') AND len(regexp_extract_all({_POOL_TEXT}, '[一-鿿]')) >= 37 AS eligible,
  length({_POOL_TEXT}) >= 3 AND regexp_matches({_POOL_TEXT}, '{_POOL_START}') AND len(regexp_extract_all({_POOL_TEXT}, '[一-鿿]')) >= 0 AS starts_well
FROM documents"""
)
def question_pool_flags(spark, sf_dir):
    """The rules of the question pool at their production length and, as the texts hold no CJK characters, at a length that asks for none."""
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", text.eligible_for_questions(t).alias("eligible"), text.eligible_for_questions(t, 3).alias("starts_well"))


@query(
    f"""WITH u AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT id, row_number() OVER (PARTITION BY left({_STRIPPED.format("text").replace("^[", "[").split("|")[0]}', '', 'g'), 80) ORDER BY id) AS k FROM u)
SELECT id FROM r WHERE k = 1"""
)
def fresh_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return golden.fresh(docs, docs.filter("id % 3 = 0").select(F.col("id").alias("chunk_id"))).select("id")


_NO_WS = r"regexp_replace({0}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', '', 'g')"
_OTHER_SQL = f"""
hit AS (
  SELECT f.query_id, f.id, f.rank, {_NO_WS.format("d.text")} AS t, {_NO_WS.format("left(b.text, 60)")} AS e
  FROM frank f JOIN gold g USING (query_id) JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 50 AND NOT list_contains(g.gold, f.id)),
gp AS (SELECT query_id, unnest(gold) AS id FROM gold), gx AS (SELECT query_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM gp JOIN vec USING (id)),
gm AS (SELECT query_id, i, avg(x) AS m FROM gx GROUP BY query_id, i), cen AS (SELECT query_id, list(m ORDER BY i) AS c FROM gm GROUP BY query_id),
kin AS (
  SELECT hit.query_id, hit.id, rank, len(list_filter(range(1, greatest(length(e) - 13, 1)), lambda i: contains(t, substr(e, i, 15)))) > 0 AS strong,
    coalesce(list_dot_product(v, c) / sqrt(list_dot_product(c, c)) >= 0.88, false) AS near
  FROM hit LEFT JOIN vec ON vec.id = hit.id LEFT JOIN cen ON cen.query_id = hit.query_id),
oth AS (
  SELECT query_id, id, rank, CASE WHEN strong THEN 'strong' ELSE 'similar' END AS kind FROM kin WHERE strong OR near
  QUALIFY strong OR row_number() OVER (PARTITION BY query_id, strong ORDER BY rank) <= 3)"""
_SHEET_SQL = f"""
g1 AS (SELECT query_id, list_min(gold) AS least FROM gold),
fr AS (SELECT gp.query_id, min(rank) AS first_rank FROM gp JOIN frank f ON f.query_id = gp.query_id AND f.id = gp.id WHERE rank <= 50 GROUP BY gp.query_id),
l AS (
  SELECT g1.query_id AS id, text, first_rank, (SELECT count(*) FROM oth o WHERE o.query_id = g1.query_id AND kind = 'strong') AS n_strong, (SELECT count(*) FROM oth o WHERE o.query_id = g1.query_id AND kind = 'similar') AS n_similar,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda v: {_STRIPPED.format("v")}), lambda v: v <> '') AS ls FROM g1 JOIN documents ON doc_id = least LEFT JOIN fr USING (query_id)),
t AS (
  SELECT id, first_rank, n_strong, n_similar, first_rank IS NULL AS w1, coalesce(first_rank > 5, false) AS w2,
    len(ls) >= 6 AND len(regexp_extract_all(coalesce(text, ''), '[。！？]')) <= 2 AND coalesce(list_aggregate(list_transform(ls, lambda v: length(v)), 'median'), 0) <= 18 AS w3, NOT regexp_matches(coalesce(text, ''), '{_POOL_START}') AS w4
  FROM l)"""


def _curation(spark, sf_dir):
    """The entries of benchmark items that documents hold, and their further hits, over the fused search; the evidence is an item's beginning."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    evidence = _items(spark, sf_dir).select("query_id", F.left("query", F.lit(60)).alias("evidence"))
    hybrid = stored(_routes(spark, sf_dir)["hybrid"], "hybrid")
    return golden.curation_entries(hybrid, _gold(spark, sf_dir), docs, evidence, _vectors(spark, sf_dir))


@query(f"WITH {_BM25.strip()}, {_GOLD.strip()}, {_OTHER_SQL.strip()} SELECT query_id, id, rank, kind FROM oth")
def other_gold_hits(spark, sf_dir):
    """Hits outside the gold that share its evidence, or are near its centroid (three a query at most)."""
    return _curation(spark, sf_dir)[1].select("query_id", "id", "rank", "kind")


@query(
    f"""WITH {_BM25.strip()}, {_GOLD.strip()}, {_OTHER_SQL.strip()}, {_SHEET_SQL.strip()}
SELECT id, array_to_string(list_filter([CASE WHEN w1 THEN 'missing' END, CASE WHEN w2 THEN 'low rank' END, CASE WHEN w3 THEN 'table' END, CASE WHEN w4 THEN 'mid-sentence' END], lambda x: x IS NOT NULL), ', ') AS tags,
  row_number() OVER (ORDER BY n_strong = 0, NOT (w1 OR w2), id) AS priority FROM t WHERE w1 OR w2 OR w3 OR w4 OR n_strong > 0 OR n_similar > 0"""
)
def curation_sheet(spark, sf_dir):
    """The worksheet's rows by priority, over the fused search's ranks of the gold."""
    return golden.worksheet(_curation(spark, sf_dir)[0]).select("id", F.array_join("tags", ", ").alias("tags"), "priority")


@query(
    f"WITH {_BM25.strip()}, {_GOLD.strip()}, {_OTHER_SQL.strip()}, {_SHEET_SQL.strip()} SELECT count(*) AS n, count(*) FILTER (n_strong > 0) AS n_strong, count(*) FILTER (n_similar > 0) AS n_similar, count(*) FILTER (w1 OR w2) AS n_bad_rank, count(*) FILTER (w3) AS n_table, count(*) FILTER (w4) AS n_mid_sentence FROM t"
)
def curation_counts(spark, sf_dir):
    return golden.curation_tallies(_curation(spark, sf_dir)[0])


@query("SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN '' ELSE left(text, 30) END AS evidence FROM benchmark")
def evidence_lookup(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return golden.with_evidence(items, items.filter("id % 3 != 0").select("id", F.left("text", F.lit(30)).alias("evidence"))).select("id", "evidence")


@query("SELECT doc_id, replace(left(text, 160), chr(10), ' / ') AS excerpt, '[REDACTED]' AS source, lang FROM documents")
def redacted_excerpts(spark, sf_dir):
    shown = {"Source": F.col("source"), "lang": F.col("lang")}
    return _table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), 160).alias("excerpt"), *scalars.redacted(shown, ("SOURCE",))).withColumnRenamed("Source", "source")


_CANDIDATES_SQL = """
i AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 3 = 1 THEN left(text, 40) || ' 上文' ELSE left(text, 40) END AS question, CASE WHEN doc_id % 13 = 0 THEN left(text, 10) ELSE substr(text, 20, 60) END AS answer,
    CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN left(text, 30) || ' never' ELSE substr(text, 5, 50) END AS evidence, text FROM documents)"""


@query(
    f"""WITH {_CANDIDATES_SQL.strip()},
r AS (
  SELECT doc_id, CASE WHEN {_STRIPPED.format("question")} = '' OR {_STRIPPED.format("answer")} = '' THEN 'missing question or answer' WHEN {_STRIPPED.format("evidence")} = '' THEN 'missing evidence'
    WHEN NOT contains({_NO_WS.format("text")}, {_NO_WS.format("evidence")}) THEN 'evidence not in chunk' WHEN contains({_NO_WS.format("question")}, {_NO_WS.format("answer")}) THEN 'answer repeats question' WHEN regexp_matches(question, '{text.META_WORDS}') THEN 'question refers to the text' END AS reason FROM i)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"""
)
def golden_validate(spark, sf_dir):
    d, t = F.col("doc_id"), F.col("text")
    part = lambda a, n: F.substring(t, a, n)
    items = _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 11 == 0, "  ").when(d % 3 == 1, F.concat(part(1, 40), F.lit(" 上文"))).otherwise(part(1, 40)).alias("question"),
        F.when(d % 13 == 0, part(1, 10)).otherwise(part(20, 60)).alias("reference_answer"),
        F.when(d % 7 == 0, "").when(d % 5 == 0, F.concat(part(1, 30), F.lit(" never"))).otherwise(part(5, 50)).alias("evidence"),
        t.alias("chunk"), F.lit("factual").alias("category"), F.lit("easy").alias("difficulty"),
    )
    return golden.drop_counts(golden.validated(items))


@query(
    r"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY left(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', '', 'g'), 80) ORDER BY doc_id) AS k FROM documents),
n AS (SELECT doc_id, coalesce(nullif(regexp_replace(lower(source), '[^a-z0-9]+', '', 'g'), ''), 'src') AS slug FROM r WHERE k = 1)
SELECT doc_id, slug || '-' || lpad(CAST(row_number() OVER (PARTITION BY slug ORDER BY doc_id) + 7 AS VARCHAR), 3, '0') AS golden_id FROM n"""
)
def golden_numbered(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    first = golden.first_of(docs, F.left(text.norm_ws(F.col("text")), F.lit(80)), ["id"]).withColumn("slug", text.slug(F.col("source")))
    last = first.select("slug").distinct().withColumn("last", F.lit(7))
    return golden.numbered(first, last, ["id"]).select(F.col("id").alias("doc_id"), "golden_id")


@query(
    """WITH p AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
s AS (SELECT e.vec_id, e.label, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.c) / sqrt(list_dot_product(c.c, c.c)), 6) AS cosine FROM embeddings e JOIN c USING (label))
SELECT vec_id, label, cosine FROM s"""
)
def centroid_similarity(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    centre = golden.centroids(rows, "label", "embedding")
    return rows.join(small(centre), "label").select("vec_id", "label", F.round(dot("embedding", "centroid"), 6).alias("cosine"))


@query(
    f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda v: {_STRIPPED.format("v")}), lambda v: v <> '') AS ls FROM documents)
SELECT doc_id, len(ls) >= 6 AND len(regexp_extract_all(text, '[。！？]')) <= 2 AND coalesce(list_median(list_transform(ls, lambda v: length(v))), 0) <= 18 AS is_table, NOT regexp_matches(text, '^[A-Za-z一-鿿0-9（(“"]') AS mid_sentence FROM l""".replace(
        "list_median(list_transform(ls, lambda v: length(v)))", "list_aggregate(list_transform(ls, lambda v: length(v)), 'median')"
    )
)
def table_shape_flags(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.looks_like_table(t), F.lit(False)).alias("is_table"), text.starts_mid_sentence(t).alias("mid_sentence"))


@query("SELECT avg(CASE WHEN length(text) >= 400 THEN 1.0::DOUBLE ELSE 0 END) AS share, avg(CASE WHEN length(text) >= 400 THEN 1.0::DOUBLE ELSE 0 END) > 0.8 AS alarm FROM documents")
def truncation_share(spark, sf_dir):
    return golden.truncation_share(_table(spark, sf_dir, "documents"))


@query(
    f"""WITH {_BM25.strip()},
b AS (SELECT query_id, id, {_NO_WS.format("i.text")} AS q, {_NO_WS.format("d.text")} AS t FROM brank JOIN benchmark i ON item_id = query_id JOIN documents d ON d.doc_id = id WHERE rank = 1),
s AS (SELECT query_id, id, q, t, unnest(range(1, length(q) + 1)) AS a FROM b), p AS (SELECT query_id, id, q, t, a, unnest(range(1, length(q) - a + 2)) AS n FROM s)
SELECT b.query_id, b.id, CAST(coalesce(max(n), 0) AS INTEGER) AS overlap FROM b LEFT JOIN p ON p.query_id = b.query_id AND contains(b.t, substr(b.q, a, n)) GROUP BY b.query_id, b.id"""
)
def evidence_overlap(spark, sf_dir):
    """Longest common substring of each benchmark passage and the best BM25 document."""
    best = retrieval.ranked_terms(_index(spark, sf_dir), _items(spark, sf_dir), 1)
    joined = best.join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id").join(small(_items(spark, sf_dir)), "query_id")
    return joined.select("query_id", "id", text.overlap_length(F.col("query"), F.col("text")).alias("overlap"))


# ---------------------------------------------------------------- calculators

_PROFILE_SQL = """
p AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, 20.0::DOUBLE + c_custkey % 150 AS weight, 90.0::DOUBLE + c_custkey % 130 AS height, 5.0::DOUBLE + c_custkey % 97 AS age,
    25.0::DOUBLE + c_custkey % 30 AS neck, 45.0::DOUBLE + c_custkey % 70 AS waist, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 60.0::DOUBLE + c_custkey % 50 END AS hip,
    ['sedentary', 'light', 'moderate', 'active', 'veryActive', 'never'][c_custkey % 6 + 1] AS activity, ['cut', 'bulk', 'maintain', 'other'][c_custkey % 4 + 1] AS goal, 1.0::DOUBLE + c_custkey % 35 AS reps, 1.0::DOUBLE + c_custkey % 70 AS fat
  FROM customer)"""


def _profiles(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    span = lambda low, n: (F.lit(float(low)) + k % n)
    return _table(spark, sf_dir, "customer").select(
        k.alias("id"), pick("male", "female").alias("sex"), span(20, 150).alias("weight"), span(90, 130).alias("height"), span(5, 97).alias("age"), span(25, 30).alias("neck"), span(45, 70).alias("waist"),
        F.when(k % 3 != 0, span(60, 50)).alias("hip"), pick(*calc.ACTIVITY, "never").alias("activity"), pick(*calc.GOALS, "other").alias("goal"), span(1, 35).alias("reps"), span(1, 70).alias("fat"),
    )


def _flat(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.select("id", "r.ok", *(F.round(f"r.data.{f}", 6).alias(f) for f in fields))


_BMR_OK = "weight BETWEEN 30 AND 300 AND height BETWEEN 100 AND 250 AND age BETWEEN 10 AND 100"
_BMR = "10 * weight + 6.25::DOUBLE * height - 5 * age + CASE WHEN sex = 'male' THEN 5 ELSE -161 END"


@query(
    f"""WITH {_PROFILE_SQL.strip()}, b AS (SELECT *, {_BMR_OK} AS ok, {_BMR} AS v FROM p)
SELECT id, ok, CASE WHEN ok THEN round(v, 6) END AS bmr, ok AND v > 0 AND activity <> 'never' AS tdee_ok,
  CASE WHEN ok AND v > 0 THEN round(v * map {{'sedentary': 1.2::DOUBLE, 'light': 1.375::DOUBLE, 'moderate': 1.55::DOUBLE, 'active': 1.725::DOUBLE, 'veryActive': 1.9::DOUBLE}}[activity], 6) END AS tdee FROM b"""
)
def calc_bmr_tdee(spark, sf_dir):
    rows = _profiles(spark, sf_dir).withColumn("r", calc.bmr(*map(F.col, ("sex", "weight", "height", "age"))))
    rows = rows.withColumn("t", calc.tdee(F.col("r.data.bmr"), F.col("activity")))
    return rows.select("id", "r.ok", F.round("r.data.bmr", 6).alias("bmr"), F.col("t.ok").alias("tdee_ok"), F.round("t.data.tdee", 6).alias("tdee"))


@query(
    f"""WITH {_PROFILE_SQL.strip()}, b AS (
  SELECT *, height BETWEEN 100 AND 250 AND neck BETWEEN 20 AND 120 AND waist BETWEEN 20 AND 120 AND (hip IS NULL OR hip BETWEEN 20 AND 120)
    AND CASE WHEN sex = 'male' THEN waist > neck ELSE hip IS NOT NULL AND waist + hip > neck END AS ok FROM p)
SELECT id, ok, CASE WHEN ok THEN round(CASE WHEN sex = 'male' THEN 495 / (1.0324::DOUBLE - 0.19077::DOUBLE * log10(waist - neck) + 0.15456::DOUBLE * log10(height)) - 450
  ELSE 495 / (1.29579::DOUBLE - 0.35004::DOUBLE * log10(waist + hip - neck) + 0.221::DOUBLE * log10(height)) - 450 END, 6) END AS bodyFatPct FROM b"""
)
def calc_body_fat(spark, sf_dir):
    return _flat(_profiles(spark, sf_dir).withColumn("r", calc.body_fat(*map(F.col, ("sex", "height", "neck", "waist", "hip")))), "bodyFatPct")


@query(
    f"""WITH {_PROFILE_SQL.strip()}, b AS (
  SELECT *, weight BETWEEN 30 AND 300 AND goal <> 'other' AS ok, 2000.0::DOUBLE * CASE goal WHEN 'cut' THEN 0.8::DOUBLE WHEN 'bulk' THEN 1.1::DOUBLE ELSE 1.0 END AS kcal, CASE goal WHEN 'cut' THEN 2.2::DOUBLE ELSE 1.8::DOUBLE END * weight AS protein FROM p)
SELECT id, ok, CASE WHEN ok THEN round(kcal, 6) END AS calories, CASE WHEN ok THEN round(protein, 6) END AS proteinG, CASE WHEN ok THEN round(kcal * 0.25::DOUBLE / 9, 6) END AS fatG,
  CASE WHEN ok THEN round(greatest(0, (kcal - protein * 4 - kcal * 0.25::DOUBLE / 9 * 9) / 4), 6) END AS carbsG FROM b"""
)
def calc_macros(spark, sf_dir):
    return _flat(_profiles(spark, sf_dir).withColumn("r", calc.macros(F.lit(2000.0), F.col("weight"), F.col("goal"))), "calories", "proteinG", "fatG", "carbsG")


@query(
    f"""WITH {_PROFILE_SQL.strip()}, b AS (
  SELECT *, weight BETWEEN 30 AND 300 AND height BETWEEN 100 AND 250 AND fat BETWEEN 2 AND 60 AS ok, weight * (1 - fat / 100) AS lean, height / 100 AS m FROM p)
SELECT id, ok, CASE WHEN ok THEN round(lean, 6) END AS leanMassKg, CASE WHEN ok THEN round(lean / (m * m), 6) END AS ffmi, CASE WHEN ok THEN round(lean / (m * m) + 6.1::DOUBLE * (1.8::DOUBLE - m), 6) END AS adjustedFfmi FROM b"""
)
def calc_ffmi(spark, sf_dir):
    return _flat(_profiles(spark, sf_dir).withColumn("r", calc.ffmi(*map(F.col, ("weight", "height", "fat")))), "leanMassKg", "ffmi", "adjustedFfmi")


@query(
    f"""WITH {_PROFILE_SQL.strip()}, b AS (SELECT *, weight BETWEEN 1 AND 1000 AND reps BETWEEN 1 AND 30 AS ok FROM p)
SELECT id, ok, CASE WHEN ok THEN round(weight * (1 + reps / 30), 6) END AS epley, CASE WHEN ok THEN round(36 * weight / (37 - reps), 6) END AS brzycki FROM b"""
)
def calc_one_rm(spark, sf_dir):
    return _flat(_profiles(spark, sf_dir).withColumn("r", calc.one_rm(F.col("weight"), F.col("reps"))), "epley", "brzycki")


@query(
    f"""WITH {_PROFILE_SQL.strip()}
SELECT id, array_to_string(list_filter([CASE WHEN NOT weight BETWEEN 30 AND 300 THEN 'weightKg: 30 to 300' END, CASE WHEN NOT height BETWEEN 100 AND 250 THEN 'heightCm: 100 to 250' END,
  CASE WHEN NOT age BETWEEN 10 AND 100 THEN 'age: 10 to 100' END], lambda x: x IS NOT NULL), '; ') AS errors FROM p"""
)
def calc_validation(spark, sf_dir):
    rows = _profiles(spark, sf_dir).withColumn("r", calc.bmr(*map(F.col, ("sex", "weight", "height", "age"))))
    shown = F.transform(F.map_entries("r.errors"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return rows.select("id", F.array_join(shown, "; ").alias("errors"))


# ---------------------------------------------------------------- matching

_RECIPE_VALUES = ", ".join(f"({i}, '{r[0]}', '{r[2]}', '{r[3]}', {', '.join(f'{float(x)}::DOUBLE' for x in r[4:8])})" for i, r in enumerate(rules.RECIPES))
_RECIPE_SQL = f"r(ord, id, category, meal_type, calories, protein_g, carbs_g, fat_g) AS (VALUES {_RECIPE_VALUES})"


@query(
    """WITH p AS (SELECT p_partkey AS ord, p_name AS id, p_retailprice AS calories FROM part),
t AS (SELECT unnest([900.0, 1200.0, 1500.0, 99999.0])::DOUBLE AS kcal), n AS (SELECT CAST(kcal AS BIGINT) AS target_id, kcal FROM t),
i AS (SELECT target_id, ord, id, calories, abs(calories - kcal) AS gap, true AS in_range FROM p JOIN n ON calories BETWEEN kcal * (1 - 0.01::DOUBLE) AND kcal * (1 + 0.01::DOUBLE)),
c AS (SELECT target_id, ord, id, calories, abs(calories - kcal) AS gap, false AS in_range, row_number() OVER (PARTITION BY target_id ORDER BY abs(calories - kcal), ord) AS k FROM p CROSS JOIN n WHERE target_id NOT IN (SELECT target_id FROM i))
SELECT target_id, ord, id, calories, round(gap, 6) AS gap, in_range FROM (SELECT * FROM i UNION ALL SELECT * EXCLUDE k FROM c WHERE k = 1)"""
)
def calorie_match(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("id"), F.col("p_retailprice").alias("calories"))
    targets = spark.createDataFrame([(int(k), float(k)) for k in (900, 1200, 1500, 99999)], "target_id long, kcal double")
    return matching.calorie_match(rows, targets, 0.01).withColumn("gap", F.round("gap", 6))


_TARGET_SQL = """
t AS (
  SELECT c_custkey AS target_id, 1200.0::DOUBLE + c_custkey % 40 * 50 AS kcal, [0.4, 0.6, 0.45, 1.0][c_custkey % 4 + 1]::DOUBLE AS carbs, [0.4, 0.3, 0.3, 0.0][c_custkey % 4 + 1]::DOUBLE AS protein, [0.2, 0.1, 0.25, 0.0][c_custkey % 4 + 1]::DOUBLE AS fat
  FROM customer)"""
_SHARES = {"carbs": (0.4, 0.6, 0.45, 1.0), "protein": (0.4, 0.3, 0.3, 0.0), "fat": (0.2, 0.1, 0.25, 0.0)}


def _targets(spark, sf_dir):
    """Each customer's calories and shares."""
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(k.alias("target_id"), (F.lit(1200.0) + k % 40 * 50).alias("kcal"), *(pick(v).alias(n) for n, v in _SHARES.items()))


@query(
    f"""WITH {_RECIPE_SQL}, {_TARGET_SQL.strip()},
c AS (
  SELECT b.ord AS bo, l.ord AS lo, d.ord AS dd, b.id AS breakfast, l.id AS lunch, d.id AS dinner, b.calories + l.calories + d.calories AS calories, b.protein_g + l.protein_g + d.protein_g AS protein_g,
    b.carbs_g + l.carbs_g + d.carbs_g AS carbs_g, b.fat_g + l.fat_g + d.fat_g AS fat_g FROM r b, r l, r d WHERE b.meal_type = 'breakfast' AND l.meal_type = 'meal' AND d.meal_type = 'meal'),
u AS (SELECT DISTINCT kcal, carbs, protein, fat FROM t),
s AS (
  SELECT u.*, c.*, abs(calories - kcal) / kcal + abs(protein_g - kcal * protein / 4) / nullif(kcal * protein / 4, 0) + abs(carbs_g - kcal * carbs / 4) / nullif(kcal * carbs / 4, 0) + abs(fat_g - kcal * fat / 9) / nullif(kcal * fat / 9, 0) AS score FROM u, c),
k AS (SELECT *, row_number() OVER (PARTITION BY kcal, carbs, protein, fat ORDER BY score, bo, lo, dd) AS k FROM s WHERE score IS NOT NULL)
SELECT target_id, breakfast, lunch, dinner, calories, protein_g, carbs_g, fat_g, round(score, 9) AS score FROM k JOIN t USING (kcal, carbs, protein, fat) WHERE k = 1"""
)
def meal_combo_argmin(spark, sf_dir):
    """The best three meals for each customer's target."""
    return matching.meal_plans(rules.recipes(spark), _targets(spark, sf_dir)).withColumn("score", F.round("score", 9))


_PLAN_VALUES = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', {p}, '{x[0]}', {x[1]}, {x[2]})" for r in rules.PLANS for p, x in enumerate(r[3]))
_EXERCISE_VALUES = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}')" for r in rules.EXERCISES)
_CHOSEN_SQL = "q AS (SELECT c_custkey AS request_id, CASE c_custkey % 6 WHEN 1 THEN 'shoulder-day' WHEN 2 THEN 'back-day' WHEN 3 THEN 'legs-day' WHEN 4 THEN 'arms-day' ELSE 'chest-day' END AS plan_id FROM customer)"


def _chosen(spark, sf_dir):
    """request_id, id: the plan that each customer's muscle group asks for."""
    return plan_for_group(spark, sf_dir).withColumnRenamed("plan_id", "id")


@query(
    f"""WITH p(id, name, muscle_group, place, exercise_id, sets, reps) AS (VALUES {_PLAN_VALUES}), e(id, name, muscle_group) AS (VALUES {_EXERCISE_VALUES}), {_CHOSEN_SQL}
SELECT request_id, p.id, p.name, p.place, coalesce(e.name, p.exercise_id) AS exercise, p.sets, p.reps FROM q JOIN p ON p.id = q.plan_id LEFT JOIN e ON e.id = p.exercise_id"""
)
def plan_lookup(spark, sf_dir):
    """The exercises of each customer's plan, by name."""
    return _chosen(spark, sf_dir).join(small(matching.plan_lookup(rules.plans(spark), rules.exercises(spark))), "id")


@query(f"""WITH m AS ({ORACLES["meal_combo_argmin"]}), {_RECIPE_SQL}, s AS (SELECT target_id, unnest([0, 1, 2]) AS slot, unnest([breakfast, lunch, dinner]) AS id FROM m)
SELECT target_id, slot, s.id, r.category, r.calories FROM s JOIN r ON r.id = s.id""")
def plan_suggestions(spark, sf_dir):
    """The three recipes of each customer's plan."""
    table = rules.recipes(spark)
    return matching.suggestions(matching.meal_plans(table, _targets(spark, sf_dir)), table).select("target_id", "slot", "id", "category", "calories")


_PRESET_SQL = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in scalars.PRESETS.items())


@query(f"SELECT c_custkey AS id, p.goal, round(2000 * carbs / 4, 6) AS t_carbs, round(2000 * protein / 4, 6) AS t_protein, round(2000 * fat / 9, 6) AS t_fat FROM customer JOIN (VALUES {_PRESET_SQL}) p(goal, carbs, protein, fat) ON p.goal = ['cut', 'bulk', 'balanced'][c_custkey % 3 + 1]")
def preset_macros(spark, sf_dir):
    """Target grams of the preset ratios."""
    presets = spark.createDataFrame([(k, *map(float, v)) for k, v in scalars.PRESETS.items()], "goal string, carbs double, protein double, fat double")
    goal = F.element_at(F.array(*map(F.lit, scalars.PRESETS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), goal.alias("goal")).join(small(presets), "goal")
    grams = matching.target_macros(F.lit(2000.0), F.col("carbs"), F.col("protein"), F.col("fat"))
    return rows.select("id", "goal", *grams).select("id", "goal", *(F.round(c, 6).alias(c) for c in ("t_carbs", "t_protein", "t_fat")))


@query(f"""WITH p(id, name, muscle_group, place, exercise_id, sets, reps) AS (VALUES {_PLAN_VALUES}), {_CHOSEN_SQL},
o AS (SELECT request_id, plan_id AS id, ['push-up', 'pull-up', 'lunge'][request_id % 3 + 1] AS gone FROM q),
k AS (SELECT request_id, o.id, place, exercise_id, sets, reps FROM o JOIN p ON p.id = o.id WHERE exercise_id <> gone UNION ALL SELECT request_id, id, 99, 'deadlift', 3, 10 FROM o)
SELECT request_id, id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY place) - 1 AS INTEGER) AS place, exercise_id, sets, reps FROM k""")
def plan_edited(spark, sf_dir):
    """Each customer's plan without the exercise they took out, and with one more at its end."""
    gone = F.element_at(F.array(*map(F.lit, ("push-up", "pull-up", "lunge"))), (F.col("request_id") % 3 + 1).cast("int"))
    owned = _chosen(spark, sf_dir).join(small(rules.plans(spark).select("id", "exercises")), "id")
    changed = owned.select("request_id", "id", F.posexplode(matching.edited(F.col("exercises"), gone, F.lit("deadlift"))).alias("place", "x"))
    return changed.select("request_id", "id", "place", "x.*")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 4 <> 0")
def new_profiles(spark, sf_dir):
    """Inserts: customers of orders that are not there yet, once each."""
    known = _table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"))
    return matching.new_rows(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), known, "id")


@query("SELECT c_custkey AS request_id, CASE c_custkey % 6 WHEN 1 THEN 'shoulder-day' WHEN 2 THEN 'back-day' WHEN 3 THEN 'legs-day' WHEN 4 THEN 'arms-day' ELSE 'chest-day' END AS plan_id FROM customer")
def plan_for_group(spark, sf_dir):
    group = F.element_at(F.array(*map(F.lit, ("chest", "shoulder", "back", "legs", "arms", "neck"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return matching.plan_for(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), group.alias("muscle_group")), rules.plans(spark))


@query(
    f"""WITH {_RECIPE_SQL}, {_TARGET_SQL.strip()}, w AS (SELECT kcal / 3 AS kcal, count(*) AS n FROM t GROUP BY kcal),
i AS (SELECT w.kcal, n, r.* FROM w JOIN r ON calories BETWEEN kcal * (1 - 0.1::DOUBLE) AND kcal * (1 + 0.1::DOUBLE)),
c AS (SELECT w.kcal, n, r.* FROM w, r WHERE w.kcal NOT IN (SELECT kcal FROM i) QUALIFY row_number() OVER (PARTITION BY w.kcal ORDER BY abs(calories - w.kcal), ord) = 1)
SELECT category, meal_type, CAST(sum(n) AS BIGINT) AS n, sum(n * calories) AS calories FROM (SELECT * FROM i UNION ALL SELECT * FROM c) GROUP BY category, meal_type"""
)
def recipe_groups(spark, sf_dir):
    """How often recipes of each category and meal fit a third of a customer's calories, and their calories."""
    wanted = _targets(spark, sf_dir).groupBy((F.col("kcal") / 3).alias("kcal")).agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"))
    table = rules.recipes(spark)
    found = matching.calorie_match(table.select("ord", "id", "calories"), wanted.select("target_id", "kcal")).select("target_id", "id", "calories")
    joined = found.join(small(wanted.select("target_id", "n")), "target_id").join(small(table.select("id", "category", "meal_type")), "id")
    return joined.groupBy("category", "meal_type").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("calories")).alias("calories"))


# ---------------------------------------------------------------- usage

_EVENTS_SQL = """
e AS (
  SELECT event_id, user_id, ts, strftime(ts + INTERVAL 480 MINUTE, '%Y-%m-%d') AS day, event_type = 'error' OR event_id % 9 = 0 AS degraded, CAST(floor(abs(value)) AS BIGINT) % 50 AS tokens FROM events)"""


def _events(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    degraded = (F.col("event_type") == "error") | (F.col("event_id") % 9 == 0)
    tokens = F.floor(F.abs(F.col("value"))).cast("long") % 50
    return usage.with_day(rows.select("event_id", "user_id", "ts", degraded.alias("degraded"), tokens.alias("tokens")), offset_minutes=480)


@query(f"WITH {_EVENTS_SQL.strip()} SELECT user_id, day, count(*) FILTER (NOT degraded) AS calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM e GROUP BY user_id, day")
def budget_daily(spark, sf_dir):
    return usage.budget_daily(_events(spark, sf_dir))


@query(
    f"""WITH {_EVENTS_SQL.strip()}, d AS (SELECT user_id, day, count(*) FILTER (NOT degraded) AS calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM e GROUP BY user_id, day)
SELECT user_id, day, CASE WHEN calls >= 3 THEN 'calls' WHEN tokens >= 60 THEN 'tokens' ELSE 'ok' END AS decision FROM d"""
)
def budget_decision(spark, sf_dir):
    return usage.budget_decision(usage.budget_daily(_events(spark, sf_dir)), 3, 60).select("user_id", "day", "decision")


_GATE_SQL = (
    _EVENTS_SQL
    + """,
g1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) <= 3 AS p1 FROM e),
g2 AS (SELECT *, coalesce(sum(CASE WHEN p1 THEN tokens ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2000 AS cut FROM g1),
g3 AS (SELECT *, coalesce(count(*) FILTER (p1 AND NOT cut) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM g2),
g AS (SELECT user_id, day, event_id, CASE WHEN prior >= 3 THEN 'calls' WHEN cut THEN 'tokens' ELSE 'ok' END AS decision FROM g3)"""
)


@query(f"WITH {_GATE_SQL.strip()} SELECT event_id, decision FROM g")
def budget_gate(spark, sf_dir):
    return usage.budget_gate(_events(spark, sf_dir), 3, 2000).select("event_id", "decision")


@query(f"WITH {_GATE_SQL.strip()} SELECT user_id, day, count(*) AS blocked FROM g WHERE decision <> 'ok' GROUP BY user_id, day")
def blocked_counter(spark, sf_dir):
    return usage.blocked_counter(usage.budget_gate(_events(spark, sf_dir), 3, 2000))


_LIMIT, _WINDOW = 2, 86_400_000


def _requests(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query(
    f"""WITH RECURSIVE q AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
b AS (
  SELECT user_id, event_id, ms, k, {_LIMIT}::DOUBLE AS held FROM q WHERE k = 1
  UNION ALL
  SELECT q.user_id, q.event_id, q.ms, q.k, least({_LIMIT}::DOUBLE, CASE WHEN b.held >= 1 THEN b.held - 1 ELSE b.held END + (q.ms - b.ms) * {_LIMIT} / {_WINDOW}) FROM b JOIN q ON q.user_id = b.user_id AND q.k = b.k + 1)
SELECT user_id, event_id, held >= 1 AS ok, CAST(round(CASE WHEN held >= 1 THEN held - 1 ELSE held END * {_WINDOW}) AS BIGINT) AS token_ms FROM b"""
)
def token_bucket(spark, sf_dir):
    return usage.token_bucket(_requests(spark, sf_dir), _LIMIT, _WINDOW).select("user_id", "event_id", "ok", F.round(F.col("tokens") * _WINDOW).cast("long").alias("token_ms"))


@query(ORACLES["token_bucket"])
def rate_limit_stream(spark, sf_dir):
    """The stream's decisions over the same events, read by one availableNow run."""
    schema = _table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    decided = run_to_end(token_bucket_stream(rows, _LIMIT, _WINDOW), "bucket")
    return decided.select("user_id", "event_id", "ok", F.round(F.col("tokens") * _WINDOW).cast("long").alias("token_ms"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, event_id, place FROM r WHERE place <= 100")
def history_top_n(spark, sf_dir):
    return matching.top_rows(_table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 100).select("user_id", "event_id", "place")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k = 1")
def latest_profile(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return matching.latest(rows, "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


@query(ORACLES["latest_profile"])
def profile_upserts(spark, sf_dir):
    """Orders written as profiles in three batches, out of order, one of them twice; a later row is never replaced by an earlier one."""
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    table = tables.KeyedTable(spark, shared_path(spark, "profiles"), "o_custkey long, o_orderkey long, o_totalprice double, o_orderdate date", ["o_custkey"], 16)
    for part, number in ((2, 0), (0, 1), (0, 1), (1, 2)):
        chosen = rows.filter(F.pmod("o_orderkey", F.lit(3)) == part)
        table.replace(chosen.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.columns)), ["o_orderdate", "o_orderkey"], ("orders", number))
    return table.read().select("o_custkey", "o_orderkey", "o_totalprice")


@query(ORACLES["blocked_counter"])
def blocked_upserts(spark, sf_dir):
    """The counter of blocked calls as a table that a stream counts up, batch by batch."""
    path = shared_path(spark, "blocked")
    decided = usage.budget_gate(_events(spark, sf_dir), 3, 2000).filter("decision != 'ok'").select("user_id", "day", F.lit(1).cast("long").alias("blocked"))
    decided.repartition(4).write.parquet(f"{path}/calls")
    table = tables.KeyedTable(spark, f"{path}/table", "user_id long, day string, blocked long", ["user_id", "day"], 16)
    calls = spark.readStream.schema(decided.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/calls")
    tables.run_into(calls, "blocked", f"{path}/state", lambda rows, batch: table.count_up(rows, ["blocked"], batch))
    return table.read().select("user_id", "day", "blocked")


_LOG_RAW = "replace(props, '\"k\"', '\"' || ['bmr', 'bodyFatPct', 'proteinG', 'ffmi', 'epley', 'k'][event_id % 6 + 1] || '\"')"


@query(
    f"""WITH l AS (SELECT event_id, event_id % 6 AS kind, {_LOG_RAW} AS raw, json_extract(props, '$.k') AS j, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE try_cast(props AS JSON) IS NOT NULL),
f AS (SELECT *, coalesce(CAST(k AS VARCHAR), '-') AS s0, coalesce(CAST(k AS VARCHAR) || '.0', '-') AS s1, coalesce(CAST(k AS VARCHAR) || '.00', '-') AS s2 FROM l)
SELECT event_id, CASE kind WHEN 0 THEN 'BMR ' || s0 || ' kcal · TDEE - kcal' WHEN 1 THEN '体脂率 ' || s1 || '%' WHEN 2 THEN '热量 - kcal · 蛋白 ' || s0 || 'g · 碳水 -g · 脂肪 -g'
  WHEN 3 THEN 'FFMI ' || s2 || ' · 标准化 - · 瘦体重 -kg' WHEN 4 THEN '1RM ' || s1 || 'kg (Epley) / -kg (Brzycki)' ELSE raw END AS line FROM f
UNION ALL SELECT event_id, {_LOG_RAW} FROM events WHERE try_cast(props AS JSON) IS NULL"""
)
def json_log_format(spark, sf_dir):
    """Events as logged calculations of all five kinds and an unknown one."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 6 + 1).cast("int"))
    field = pick("bmr", "bodyFatPct", "proteinG", "ffmi", "epley", "k")
    raw = F.replace(F.col("props"), F.lit('"k"'), F.concat(F.lit('"'), field, F.lit('"')))
    return _table(spark, sf_dir, "events").select("event_id", scalars.log_line(pick(*scalars.LOG_LINES, "other"), raw).alias("line"))


@query(
    """SELECT event_id, regexp_matches(k, '^[A-Za-z0-9_.:-]{1,64}$') AS valid, nullif(left(regexp_replace(k, '[^A-Za-z0-9_.:-]', '', 'g'), 64), '') AS cleaned,
  CAST(floor(least(8000.0::DOUBLE, 500.0::DOUBLE * power(2.0::DOUBLE, event_id % 7)) / 2 + (event_id % 5) / 4.0::DOUBLE * least(8000.0::DOUBLE, 500.0::DOUBLE * power(2.0::DOUBLE, event_id % 7)) / 2 + 0.5::DOUBLE) AS BIGINT) AS delay_ms,
  CAST(greatest(1, ceil((event_id * 37 % 9000) / 1000.0::DOUBLE)) AS INTEGER) AS retry_after
FROM (SELECT event_id, event_type || repeat(':', CAST(event_id % 4 AS BIGINT)) || coalesce(props, '') || repeat('x', CAST(event_id % 90 AS BIGINT)) AS k FROM events)"""
)
def request_headers(spark, sf_dir):
    """Request ids checked and cleaned, and the waits before another try."""
    i = F.col("event_id")
    k = F.concat("event_type", F.repeat(F.lit(":"), (i % 4).cast("int")), F.coalesce("props", F.lit("")), F.repeat(F.lit("x"), (i % 90).cast("int")))
    rows = _table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    wait = scalars.backoff(i % 7, 500.0, 8000.0, (i % 5) / 4.0)
    return rows.select("event_id", F.col("k").rlike(scalars.REQUEST_ID).alias("valid"), scalars.cleaned_request_id(F.col("k")).alias("cleaned"), wait.alias("delay_ms"), scalars.retry_after_seconds(i * 37 % 9000).alias("retry_after"))


@query(
    """WITH q AS (SELECT c_custkey AS k, c_custkey % 5 AS a, c_custkey % 7 AS b, c_custkey % 3 AS f FROM customer)
SELECT k, CASE WHEN a + b + f > 0 THEN round(a / CAST(a + b + f AS DOUBLE), 9) END AS carbs, CASE WHEN a + b + f > 0 THEN round(b / CAST(a + b + f AS DOUBLE), 9) END AS protein, CASE WHEN a + b + f > 0 THEN round(f / CAST(a + b + f AS DOUBLE), 9) END AS fat FROM q"""
)
def macro_shares(spark, sf_dir):
    """A customer's grams as shares of their sum; null where there are none."""
    k = F.col("c_custkey")
    r = scalars.ratios((k % 5).cast("double"), (k % 7).cast("double"), (k % 3).cast("double"))
    return _table(spark, sf_dir, "customer").select(k.alias("k"), r.alias("r")).select("k", *(F.round(f"r.{n}", 9).alias(n) for n in ("carbs", "protein", "fat")))


@query("SELECT vec_id, sha256(CAST(len(embedding) AS VARCHAR) || ':' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',')) AS digest FROM embeddings")
def vector_bytes(spark, sf_dir):
    """Vectors written as bytes and read back."""
    stored_bytes = _table(spark, sf_dir, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("b"))
    back = stored_bytes.select("vec_id", vectors.from_bytes("b").alias("v"))
    whole = F.transform("v", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return back.select("vec_id", F.sha2(F.concat(F.size("v").cast("string"), F.lit(":"), F.array_join(whole, ",")), 256).alias("digest"))


@query(
    """WITH g AS (SELECT doc_id, coalesce(nullif(regexp_replace(lower(source), '[^a-z0-9]+', '', 'g'), ''), 'src') AS slug FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT slug, max(doc_id % 1000) AS last FROM g GROUP BY slug)
SELECT doc_id, s.slug || '-' || lpad(CAST(row_number() OVER (PARTITION BY s.slug ORDER BY doc_id) + coalesce(n.last, 0) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (PARTITION BY s.slug ORDER BY doc_id) + coalesce(n.last, 0) AS VARCHAR))) AS INTEGER), '0') AS golden_id
FROM (SELECT doc_id, coalesce(nullif(regexp_replace(lower(source), '[^a-z0-9]+', '', 'g'), ''), 'src') AS slug FROM documents WHERE doc_id % 2 <> 0) s LEFT JOIN n USING (slug)"""
)
def golden_resume(spark, sf_dir):
    """A first run's golden rows appended as JSON lines and read again: chunks that it used stay out, numbers go on from its last ones."""
    path = shared_path(spark, "golden")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", text.slug(F.col("source")).alias("slug"))
    done = docs.filter("id % 2 = 0")
    rows = done.select(F.concat("slug", F.lit("-"), (F.col("id") % 1000).cast("string")).alias("id"), F.left("text", F.lit(20)).alias("question"), F.array("id").alias("gold_chunk_ids"))
    for part in (0, 1):  # two appends
        files.append_json_lines(rows.filter(F.pmod(F.col("gold_chunk_ids")[0], F.lit(4)) == 2 * part), path)
    state = files.resume_state(files.json_lines(spark, path))
    rest = docs.join(state.used_chunks.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    return golden.numbered(rest.select("id", "slug"), state.last_numbers, ["id"]).select(F.col("id").alias("doc_id"), "golden_id")


@query("SELECT event_id, strftime(date_trunc('day', ts + INTERVAL 480 MINUTE) - INTERVAL 480 MINUTE, '%Y-%m-%d %H:%M:%S') AS day_start, strftime(ts + INTERVAL 480 MINUTE, '%Y-%m-%d') AS day FROM events")
def day_windows(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(scalars.start_of_day(ts, 480), "yyyy-MM-dd HH:mm:ss").alias("day_start"), scalars.day_key(ts, 480).alias("day"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 3 = 0 THEN 400 + event_id % 200 = 429 OR 400 + event_id % 200 >= 500 WHEN event_id % 7 = 0 THEN true WHEN event_id % 11 = 0 THEN true ELSE false END AS retry,
  round(CASE WHEN value >= 0 THEN 1 / (1 + exp(-value)) ELSE exp(value) / (1 + exp(value)) END, 9) AS p FROM events"""
)
def retry_and_sigmoid(spark, sf_dir):
    i = F.col("event_id")
    name = F.when(i % 5 == 0, "AbortError").when(i % 7 == 0, "TimeoutError").otherwise("Error")
    status = F.when(i % 3 == 0, 400 + i % 200)
    code = F.when(i % 11 == 0, "ECONNRESET").otherwise("EACCES")
    retry = scalars.retryable(name, status, code, F.lit(False), F.lit(""))
    return _table(spark, sf_dir, "events").select("event_id", retry.alias("retry"), F.round(scalars.sigmoid(F.col("value")), 9).alias("p"))


_USAGE_SQL = "CASE WHEN event_id % 5 = 0 THEN 'broken' WHEN event_id % 2 = 0 THEN '{\"prompt_tokens\": ' || event_id || ', \"completion_tokens\": 7}' ELSE '{\"input_tokens\": 3, \"cache_read_input_tokens\": ' || event_id || ', \"cache_creation_input_tokens\": null}' END"


@query(
    """SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 2 = 0 THEN event_id ELSE 3 + event_id END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN 7 ELSE 0 END AS BIGINT) AS completion_tokens FROM events"""
)
def usage_normalised(spark, sf_dir):
    provider = F.when(F.col("event_id") % 2 == 0, "deepseek").otherwise("claude")
    return _table(spark, sf_dir, "events").select("event_id", scalars.usage_tokens(provider, F.expr(_USAGE_SQL)).alias("u")).select("event_id", "u.*")


@query("SELECT c_custkey AS id, ['胸', '肩', '背', '腿', '臂', 'neck'][c_custkey % 6 + 1] AS shown FROM customer")
def group_labels(spark, sf_dir):
    group = F.element_at(F.array(*map(F.lit, (*scalars.GROUP_LABELS, "neck"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalars.labelled(group, scalars.GROUP_LABELS).alias("shown"))


#: Second names from before the SQL of the first ones was put right; the same queries.
for _name, _of in {
    "dense_topk_all": "dense_topk", "retrieval_curve": "retrieval_metrics", "curve_by_group": "metrics_by_group",
    "fusion_depths": "fusion_depth_sweep", "interleaved_sources": "golden_interleave",
}.items():
    QUERIES[_name], ORACLES[_name] = QUERIES[_of], ORACLES[_of]
