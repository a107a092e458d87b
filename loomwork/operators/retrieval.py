"""Retrieval over chunks: BM25, dense vectors, rank fusion, re-ranking, and the search that composes them.

Queries are the small side and come many at once; chunks are never collected. Ranks are by the
score rounded to 9 digits, then by id, so equal scores have a fixed order in every engine.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import tokenize
from loomwork.functions.vectors import dot
from loomwork.operators import lexical
from loomwork.operators.lexical import ranked_terms
from loomwork.operators.nearest import nearest
from loomwork.sources.shared import small, stored

# Fixed values of the fusion and of the pools.
RRF_K = 60
CANDIDATES, RERANK_POOL = 50, 100
MODES = ("dense", "bm25", "hybrid")


def ranked(scores: DataFrame, most: int, score: str = "score", query: str = "query_id", key: str = "id") -> DataFrame:
    """scores with rank, the best `most` of each query; none if most is not above 0."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), key)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(most, 0))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs (texts without tokens included), n_terms, n_tokens, avgdl (0 for no text)."""
    return lexical.corpus_stats(lexical.index_of(docs.select(F.lit(0).alias("doc_id"), text), text=text))


def bm25(docs: DataFrame, queries: DataFrame, most: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, id, score, rank of the texts that hold a term of the query; queries: query_id, query.

    The texts are indexed once, in the shared folder; for files that are asked again lexical.FileIndex keeps an index."""
    return ranked_terms(lexical.index_of(docs, key, text), queries, most)


def dense(vectors: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query_id, id, score (dot product of unit vectors), rank; vectors: id, v; queries: query_id, q."""
    return nearest(vectors, queries, most)


def fused(routes: list[DataFrame], most: int, k: int = RRF_K) -> DataFrame:
    """query_id, id, score (sum of 1 / (k + rank) over the routes), rank."""
    parts = None
    for r in routes:
        one = r.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return ranked(parts.groupBy("query_id", "id").agg(F.sum("part").alias("score")), most)


def fused_at(routes: list[DataFrame], depths: list[int], k: int = RRF_K) -> DataFrame:
    """depth, query_id, id, score, rank: the routes fused anew at each depth from their first `depth` rows, as many kept."""
    parts = None
    for r in routes:
        one = r.select("query_id", "id", "rank", (1.0 / (k + F.col("rank"))).alias("part"), F.explode(F.array(*map(F.lit, depths))).alias("depth"))
        one = one.filter(F.col("rank") <= F.col("depth")).drop("rank")
        parts = one if parts is None else parts.unionByName(one)
    scores = parts.groupBy("depth", "query_id", "id").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("depth", "query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("depth"))


def reranked(base: DataFrame, scores: DataFrame, pool: int) -> DataFrame:
    """base (query_id, id, rank) with its first `pool` rows in the order of rerank_score; the rest as they were.

    Adds rerank_score, base_rank and a new rank. Where any of a query's pool has no score the model has failed: the whole
    query keeps its order and has no scores."""
    joined = base.join(scores.select("query_id", "id", "rerank_score"), ["query_id", "id"], "left")
    inside = F.col("base_rank") <= pool
    own = Window.partitionBy("query_id")
    pos = joined.withColumnRenamed("rank", "base_rank")
    whole = F.min(F.when(inside, F.col("rerank_score").isNotNull())).over(own)
    pos = pos.withColumn("rerank_score", F.when(inside & whole, F.col("rerank_score")))
    order = own.orderBy(~inside, F.desc_nulls_last(F.round("rerank_score", 9)), "base_rank")
    return pos.withColumn("rank", F.row_number().over(order))


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a re-ranking model: the share of the query's distinct terms that the text has."""
    q, t = F.array_distinct(tokenize(query)), F.array_distinct(tokenize(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))


#: Models of this worker by scorer: the loaded model, or None once it has failed.
_LOADED: dict[str, Callable[[list[tuple[str, str]]], list[float]] | None] = {}


def loaded_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16, most_tokens: int = 512, sticks: bool = True) -> Callable[[Column, Column], Column]:
    """A re-ranking model as a column function: logits of (query, text) pairs, as probabilities.

    `load` is called once in each worker, when its first pair comes. Pairs go to the model `batch` at a time, those of like length
    together, and scores come back in the rows' order. Of a pair that is too long only the text is cut (in words), never the query.
    A model that cannot be loaded or, if `sticks`, fails on a batch has failed for good: that worker's further pairs have null scores, and it
    is not tried again. Else only the pairs of that batch have none. `reranked` leaves a query with such a pair in its order."""
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        pairs = [(q or "", " ".join((t or "").split(" ")[: max(0, most_tokens - len((q or "").split(" ")))])) for q, t in zip(query, text, strict=True)]
        out: list[float | None] = [None] * len(pairs)
        by_length = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
        if pairs and name not in _LOADED:
            _LOADED[name] = None  # what it stays if loading fails
            try:
                _LOADED[name] = load()
            except Exception:  # a failing model must not fail the search
                pass
        for begin in range(0, len(pairs), batch):
            model = _LOADED[name]
            if model is None:
                break
            chosen = by_length[begin : begin + batch]
            try:
                scores = [1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x)) for x in model([pairs[i] for i in chosen])]
                given = list(zip(chosen, scores, strict=True))
            except Exception:
                given = []
                if sticks:
                    _LOADED[name] = None
            for i, x in given:
                out[i] = x
        return pd.Series(out, dtype="float64")

    return score


def batched_scorer(model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16, most_tokens: int = 512) -> Callable[[Column, Column], Column]:
    """As loaded_scorer, of a model that is there already: a batch that it fails on does not keep it from the others."""
    return loaded_scorer(lambda: model, batch, most_tokens, sticks=False)


@dataclass(frozen=True)
class Mode:
    base: str
    pool: int = 0


def parse_mode(mode: str | None, default: str = "dense") -> Mode | None:
    """dense, bm25 or hybrid, with +rerankN or without; None for anything else."""
    found = re.fullmatch(r"(dense|bm25|hybrid)(?:\+rerank(\d+))?", (mode or default).strip().lower())
    return Mode(found[1], int(found[2] or 0)) if found else None


def pool_size(top_k: int, candidates: int | None, rerank: bool) -> int:
    n = max(candidates or CANDIDATES, top_k)
    return max(n, RERANK_POOL) if rerank else n


def search(
    chunks: DataFrame, queries: DataFrame, mode: str | None = None, top_k: int = 5, candidates: int | None = None,
    rerank: Callable[[Column, Column], Column] = overlap_score, index: DataFrame | None = None,
) -> DataFrame:
    """query_id, id, text, source, score (cosine in every mode), rank, dense_rank, rrf, rerank_score, rerank_rank.

    chunks: id, text, source, embedding (unit); queries: query_id, query, q (unit). A chunk without a vector is found by its
    terms alone and has no cosine. index: the chunks' index, if there is one already. An unknown mode or
    vectors of different lengths are ValueErrors before any work on the chunks. The routes are written to the shared folder
    while the search is built."""
    asked = parse_mode(mode)
    if asked is None:
        raise ValueError(f"unknown mode: {mode}")
    vectors = chunks.select("id", F.col("embedding").alias("v")).filter("v is not null")
    span = lambda rows, v: tuple(rows.agg(F.min(F.size(v)), F.max(F.size(v))).first())
    asked_for, held = span(queries.filter("q is not null"), "q"), span(vectors, "v")
    if None not in (*asked_for, *held) and len({*asked_for, *held}) > 1:
        raise ValueError(f"vectors have {held[0]} to {held[1]} numbers, queries {asked_for[0]} to {asked_for[1]}")
    n = pool_size(top_k, candidates, asked.pool > 0)
    by_vector = stored(dense(vectors, queries.select("query_id", "q"), n), "dense")
    nothing = F.lit(None).cast("double")
    if asked.base == "dense":
        pool = by_vector.select("query_id", "id", "rank", nothing.alias("rrf"))
    else:
        terms = lexical.index_of(chunks, "id") if index is None else index
        by_terms = stored(ranked_terms(terms, queries.select("query_id", "query"), n), "terms")
        pool = by_terms.select("query_id", "id", "rank", nothing.alias("rrf")) if asked.base == "bm25" else fused([by_vector, by_terms], n).select("query_id", "id", "rank", F.col("score").alias("rrf"))
    shown = pool.join(chunks.select("id", "text", "source"), "id").join(small(queries.select("query_id", "query")), "query_id")
    if asked.pool:
        head = shown.filter(F.col("rank") <= asked.pool)
        scored = head.select("query_id", "id", rerank(F.col("query"), F.col("text")).alias("rerank_score"))
        shown = reranked(shown, scored, asked.pool).withColumn("rerank_rank", F.when(F.col("base_rank") <= asked.pool, F.col("base_rank")))
    else:
        shown = shown.withColumn("rerank_score", nothing).withColumn("rerank_rank", F.lit(None).cast("int"))
    best = shown.filter(F.col("rank") <= top_k)
    dense_rank = by_vector.select("query_id", "id", F.col("rank").alias("dense_rank"))
    pairs = best.join(vectors, "id", "left").join(queries.select("query_id", "q"), "query_id").withColumn("score", dot("q", "v"))
    return pairs.join(dense_rank, ["query_id", "id"], "left").select("query_id", "id", "text", "source", "score", "rank", "dense_rank", "rrf", "rerank_score", "rerank_rank")


def ask_prompts(found: DataFrame) -> DataFrame:
    """query_id, context, prompt, sources (first seen first) from search rows."""
    from loomwork.functions.text import ANSWER_PROMPT, format_chunks

    grouped = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("items"))
    context = format_chunks(F.col("items"))
    return grouped.select("query_id", context.alias("context"), F.format_string(ANSWER_PROMPT, context).alias("prompt"), F.array_distinct("items.source").alias("sources"))
