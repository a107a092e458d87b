"""Building and curating question sets: sampling, validation, ids, and checks of the gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import META_WORDS, eligible_for_questions, looks_like_table, norm_ws, overlap_length, starts_mid_sentence, strip
from loomwork.functions.vectors import dot, normalise
from loomwork.operators import running
from loomwork.sources.shared import small, stored

CATEGORIES = ("factual", "numeric", "procedural", "comparative")
DIFFICULTIES = ("easy", "medium", "hard")
EVIDENCE, STRONG_COSINE, MOST_SIMILAR = 15, 0.88, 3


def question_pool(chunks: DataFrame, least: int = 150) -> DataFrame:
    return chunks.filter(eligible_for_questions(F.col("text"), least))


def interleaved(rows: DataFrame, source: str = "source", key: str = "id", seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """rows with turn and place: each source in a seeded order (or that of `order`), one of each in turn, sources by name."""
    by = order or ["_seeded", key]
    turns = running.numbered_within(rows.withColumn("_seeded", F.xxhash64(key, F.lit(seed))), source, by, "turn")
    return running.numbered(turns.drop("_seeded"), ["turn", source], "place")


def drop_reason(question: Column, answer: Column, evidence: Column, chunk: Column) -> Column:
    """Why a candidate is dropped, by the first rule that fits; null if it stays."""
    text = lambda x: strip(F.coalesce(x, F.lit("")))
    q, a, e = text(question), text(answer), text(evidence)
    return (
        F.when((q == "") | (a == ""), "missing question or answer")
        .when(e == "", "missing evidence")
        .when(~F.contains(norm_ws(F.coalesce(chunk, F.lit(""))), norm_ws(e)), "evidence not in chunk")
        .when(F.contains(norm_ws(q), norm_ws(a)), "answer repeats question")
        .when(q.rlike(META_WORDS), "question refers to the text")
    )


def validated(items: DataFrame) -> DataFrame:
    """items (question, reference_answer, evidence, chunk, category, difficulty) with reason and default labels."""
    known = lambda c, values, default: F.when(F.col(c).isin(*values), F.col(c)).otherwise(default).alias(c)
    reason = drop_reason(*map(F.col, ("question", "reference_answer", "evidence", "chunk")))
    others = [c for c in items.columns if c not in ("category", "difficulty")]
    return items.withColumn("reason", reason).select(*others, known("category", CATEGORIES, "factual"), known("difficulty", DIFFICULTIES, "medium"), "reason")


def drop_counts(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def first_of(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_k = 1").drop("_k")


def fresh(pool: DataFrame, used_chunks: DataFrame, prefix: int = 80) -> DataFrame:
    """Chunks that no earlier run used, one for each beginning of `prefix` characters."""
    unused = pool.join(used_chunks.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    return first_of(unused, F.left(norm_ws(F.col("text")), F.lit(prefix)), ["id"])


def numbered(rows: DataFrame, last_numbers: DataFrame, order: list[str]) -> DataFrame:
    """rows (slug, ...) with golden_id: slug and a number that goes on from the slug's last one."""
    joined = running.numbered_within(rows, "slug", order, "_n").join(last_numbers, "slug", "left").withColumn("_n", F.col("_n") + F.coalesce("last", F.lit(0)))
    number = F.col("_n").cast("string")
    return joined.withColumn("golden_id", F.concat("slug", F.lit("-"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))).drop("_n", "last")


def truncation_share(chunks: DataFrame, size: int = 400) -> DataFrame:
    """share of chunks of full size, and alarm above 0.8."""
    return chunks.agg(F.avg((F.length("text") >= size).cast("int")).alias("share")).withColumn("alarm", F.coalesce(F.col("share") > 0.8, F.lit(False)))


def centroids(members: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: the mean of its vectors at length 1. One row a group and dimension is aggregated."""
    parts = members.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return whole.select(group, normalise(F.col("mean")).alias("centroid"))


def other_gold(hits: DataFrame, centroid: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits that may be gold too: `strong` if they share the evidence, `similar` if near the gold's centroid.

    hits: query_id, id, rank, text, evidence (non-gold rows); at most three similar ones a query, by rank. A hit without a
    vector, or of a query without a centroid, has no cosine and can only be strong."""
    shared = hits.withColumn("overlap", overlap_length(F.col("evidence"), F.col("text")))
    near = shared.join(vectors, "id", "left").join(small(centroid), "query_id", "left").withColumn("cosine", dot("v", "centroid"))
    strong = F.col("overlap") >= EVIDENCE
    kind = F.when(strong, "strong").when(F.col("cosine") >= STRONG_COSINE, "similar")
    found = near.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank"))
    return found.withColumn("_k", place).filter((F.col("kind") == "strong") | (F.col("_k") <= MOST_SIMILAR)).select("query_id", "id", "rank", "kind", "overlap", "cosine")


def curation_entries(ranked: DataFrame, gold: DataFrame, chunks: DataFrame, evidence: DataFrame, vectors: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The sheet's entries (id, first_rank, n_strong, n_similar, warnings) of each query with gold, and its hits that may be gold too.

    ranked: query_id, id, rank of a search; gold: query_id, gold, category; chunks: id, text; evidence: query_id, evidence; vectors: id, v. The gold
    chunk shown is that of the smallest id."""
    first = ranked.filter(F.col("rank") <= most)
    asked = gold.filter(F.size("gold") > 0)
    pairs = asked.select("query_id", F.explode("gold").alias("id"))
    others = first.join(small(asked.select("query_id")), "query_id").join(small(pairs), ["query_id", "id"], "left_anti")
    met = small(others.select("query_id", "id", "rank"))  # so that no text is shuffled
    hits = chunks.select("id", "text").join(met, "id").join(small(evidence.select("query_id", "evidence")), "query_id")
    centre = centroids(vectors.join(small(pairs), "id").select("query_id", "v"), "query_id", "v")
    found = stored(other_gold(hits, centre, vectors), "other_gold")
    ranks = first.join(small(pairs), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    counts = found.groupBy("query_id").agg(F.count_if(F.col("kind") == "strong").alias("n_strong"), F.count_if(F.col("kind") == "similar").alias("n_similar"))
    least = asked.select("query_id", F.array_min("gold").alias("id"))
    texts = chunks.select("id", "text").join(small(least.select("id").distinct()), "id", "left_semi")
    shown = least.join(texts, "id", "left").drop("id")
    rows = shown.join(ranks, "query_id", "left").join(counts, "query_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.col("query_id").alias("id"), "first_rank", number("n_strong"), number("n_similar"), gold_warnings(F.col("text"), F.col("first_rank")).alias("warnings")), found


#: What is wrong with a gold chunk, in the order of the checks.
WARNINGS = ("gold not found", "gold below rank 5", "gold looks like a table", "gold starts mid-sentence")
SHORT_TAGS = dict(zip(WARNINGS, ("missing", "low rank", "table", "mid-sentence"), strict=True))


def with_evidence(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """items (id, ...) with the evidence that their candidate quoted; empty where there is none."""
    quoted = candidates.select("id", F.col("evidence").alias("_evidence"))
    return items.drop("evidence").join(quoted, "id", "left").withColumn("evidence", F.coalesce("_evidence", F.lit(""))).drop("_evidence")


def gold_warnings(chunk: Column, rank: Column) -> Column:
    """An array of WARNINGS that fit a gold chunk and its first rank (null if it was not found)."""
    text = F.coalesce(chunk, F.lit(""))
    tests = (rank.isNull(), rank > 5, looks_like_table(text), starts_mid_sentence(text))
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(w)) for t, w in zip(tests, WARNINGS, strict=True))), lambda w: w.isNotNull())


def short_tags(warnings: Column) -> Column:
    """The short form of each warning; others as they are."""
    return F.transform(warnings, lambda w: F.coalesce(*(F.when(w == k, F.lit(v)) for k, v in SHORT_TAGS.items()), w))


def worksheet(entries: DataFrame) -> DataFrame:
    """Rows of a curation sheet with `tags` and `priority` (from 1), those that need a look only.

    entries: id, first_rank, warnings, n_strong, n_similar. Entries with strong other gold come first, then
    those whose gold was missed or ranked low, then by id. Ranks are counted in spans of that order."""
    need = entries.filter((F.size("warnings") > 0) | (F.col("n_strong") > 0) | (F.col("n_similar") > 0))
    late = ~F.arrays_overlap("warnings", F.array(*map(F.lit, WARNINGS[:2])))
    keyed = need.withColumns({"tags": short_tags(F.col("warnings")), "_weak": F.col("n_strong") == 0, "_late": late})
    return running.numbered(keyed, ["_weak", "_late", "id"], "priority").drop("_weak", "_late")


def curation_tallies(entries: DataFrame) -> DataFrame:
    """One row: n, and how many entries have strong or similar other gold, a bad rank, a table, a cut sentence."""
    has = lambda w: F.array_contains("warnings", w)
    bad = F.col("first_rank").isNull() | (F.col("first_rank") > 5)
    tests = {"n_strong": F.col("n_strong") > 0, "n_similar": F.col("n_similar") > 0, "n_bad_rank": bad, "n_table": has(WARNINGS[2]), "n_mid_sentence": has(WARNINGS[3])}
    return entries.agg(F.count("*").alias("n"), *(F.count_if(t).alias(name) for name, t in tests.items()))
