"""Quality of retrieval and of answers: recall, reciprocal ranks, contingency, sweeps, judges."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.running import medians
from loomwork.sources.shared import small

KS = (1, 3, 5, 10, 20, 50, 100)
AXES = ("faithfulness", "relevance", "sufficiency")


def retrieval_rows(ranked: DataFrame, gold: DataFrame, most: int = max(KS)) -> DataFrame:
    """query_id, category, gold, ranked (ids by rank), first_rank (of a gold id, or null).

    gold: query_id, gold (array), category; queries without gold are left out."""
    answerable = gold.filter(F.size("gold") > 0)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    lists = ranked.filter(F.col("rank") <= most).groupBy("query_id").agg(pairs.alias("ranked"))
    joined = answerable.join(lists, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<bigint>")))
    places = F.filter(F.transform(F.col("gold"), lambda g: F.array_position("ranked", g)), lambda p: p > 0)
    return joined.select("query_id", "category", "gold", "ranked", F.array_min(places).alias("first_rank"))


def _measures(k: int = 5) -> list[Column]:
    r = F.col("first_rank")
    at = [F.avg(F.size(F.array_intersect("gold", F.slice("ranked", 1, n))) / F.size("gold")).alias(f"recall_{n}") for n in KS]
    hit = [F.avg(F.when(r <= n, 1.0).otherwise(0.0)).alias(f"hit_{n}") for n in KS]
    return [
        F.count("*").alias("n"), *at, *hit,
        F.avg(F.when(r <= k, 1 / r).otherwise(0.0)).alias(f"mrr_{k}"),
        F.avg(F.when(r == 1, 1.0).otherwise(0.0)).alias("top1_share"),
        F.avg(F.when(r.between(2, k), 1.0).otherwise(0.0)).alias(f"rank2_{k}_share"),
        F.count_if(r.isNull()).alias("misses"),
    ]


def retrieval_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Recall (share of the gold found), hit rate, reciprocal rank to 5, top-1 share and misses."""
    return rows.groupBy(*by).agg(*_measures())


def production_metrics(rows: DataFrame, by: tuple[str, ...] = (), page: int | None = None) -> DataFrame:
    """As a search page counts: recall is the share of queries with a hit, reciprocal ranks have no limit.

    With `page`, hit_recall and mrr are those of the first `page` ranks, and pool_recall and pool_mrr are those of all."""
    r = F.col("first_rank")
    measures = lambda rank: (F.avg(F.when(rank.isNotNull(), 1.0).otherwise(0.0)), F.avg(F.coalesce(1 / rank, F.lit(0.0))))
    shown = zip(measures(r if page is None else F.when(r <= page, r)), ("hit_recall", "mrr"), strict=True)
    whole = () if page is None else zip(measures(r), ("pool_recall", "pool_mrr"), strict=True)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(x.alias(name) for x, name in (*shown, *whole)))


def latency_summary(rows: DataFrame) -> DataFrame:
    """Exact medians of ms and rerank_ms and the mean of top1_score, nulls skipped."""
    held = medians(rows, ["ms", "rerank_ms"]).select(F.col("ms").alias("median_ms"), F.col("rerank_ms").alias("median_rerank_ms"))
    return held.join(F.broadcast(rows.agg(F.avg("top1_score").alias("mean_top1_score"))))  # one row each


def mode_contingency(rows: DataFrame, modes: list[str], k: int = 5) -> DataFrame:
    """mode_a, mode_b, both, only_a, only_b, neither, either for each pair of modes; rows: query_id, mode, first_rank."""
    wide = rows.groupBy("query_id").pivot("mode", modes).agg(F.max(F.when(F.col("first_rank") <= k, 1).otherwise(0)))
    counts = []
    for a, b in combinations(modes, 2):
        x, y = F.col(f"`{a}`") == 1, F.col(f"`{b}`") == 1
        cells = (("both", x & y), ("only_a", x & ~y), ("only_b", ~x & y), ("neither", ~x & ~y), ("either", x | y))
        counts.append(F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b"), *(F.count_if(c).alias(n) for n, c in cells)))
    return wide.agg(F.array(*counts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def oracle_ceiling(rows: DataFrame, k: int = 5) -> DataFrame:
    """n, found: queries that any mode answers within k."""
    return rows.groupBy("query_id").agg(F.max(F.when(F.col("first_rank") <= k, 1).otherwise(0)).alias("any")).agg(F.count("*").alias("n"), F.sum("any").alias("found"))


def mode_delta(metrics: DataFrame, value: str, order: str = "ord") -> DataFrame:
    """metrics with delta: value minus that of the mode before; metrics has one row a mode."""
    return metrics.withColumn("delta", F.col(value) - F.lag(value).over(Window.orderBy(order)))


def depth_rows(fused: DataFrame, gold: DataFrame, depths: list[int]) -> DataFrame:
    """query_id, depth, first_rank (of a gold id, or null) for each query with gold and each depth.

    fused: depth, query_id, id, rank; gold: query_id, gold."""
    asked = gold.filter(F.size("gold") > 0).select("query_id", "gold")
    found = fused.join(small(asked.select("query_id", F.explode("gold").alias("id")).distinct()), ["query_id", "id"])
    first = found.groupBy("query_id", "depth").agg(F.min("rank").alias("first_rank"))
    return asked.select("query_id", F.explode(F.array(*map(F.lit, depths))).alias("depth")).join(first, ["query_id", "depth"], "left")


def depth_metrics(rows: DataFrame, k: int = 5) -> DataFrame:
    """depth, in_pool_share, the measures of each depth's own ranks, and n_changed: queries whose first rank is
    not that of the least depth. rows: query_id, depth, first_rank."""
    r = F.col("first_rank")
    measures = rows.groupBy("depth").agg(
        F.count("*").alias("n"), F.avg(F.when(r.isNotNull(), 1.0).otherwise(0.0)).alias("in_pool_share"), F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}"),
        F.avg(F.when(r <= k, 1 / r).otherwise(0.0)).alias(f"mrr_{k}"), F.avg(F.when(r == 1, 1.0).otherwise(0.0)).alias("top1_share"), F.count_if(r.isNull()).alias("misses"),
    )
    least = rows.groupBy("query_id").agg(F.min_by("first_rank", "depth").alias("first_rank"))
    return measures.join(changed_ranks(rows, least, ("depth",)), "depth")


def changed_ranks(rows: DataFrame, other: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n_changed: queries whose first rank differs, nulls equal."""
    b = other.select("query_id", F.col("first_rank").alias("other_rank"))
    return rows.join(b, "query_id").groupBy(*by).agg(F.count_if(~F.col("first_rank").eqNullSafe(F.col("other_rank"))).alias("n_changed"))


def rerank_pool_curve(pool: DataFrame, gold: DataFrame, depths: list[int], ms_per_row: float, k: int = 5) -> DataFrame:
    """Quality for each depth of re-ranking from one scoring of the whole pool.

    pool: query_id, id, rank, rerank_score; gold: query_id, gold. At depth n the first n rows go by
    score, the rest stay. Time is estimated in proportion to n."""
    spread = pool.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    inside = F.col("rank") <= F.col("depth")
    order = Window.partitionBy("query_id", "depth").orderBy(~inside, F.when(inside, -F.round("rerank_score", 9)), "rank")
    placed = spread.withColumn("place", F.row_number().over(order)).join(small(gold.select("query_id", "gold")), "query_id")
    first = placed.groupBy("query_id", "depth").agg(F.min(F.when(F.array_contains("gold", F.col("id")), F.col("place"))).alias("first_rank"))
    r = F.col("first_rank")
    return first.groupBy("depth").agg(
        F.count("*").alias("n"), F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}"), F.avg(F.when(r <= k, 1 / r).otherwise(0.0)).alias(f"mrr_{k}"),
        F.avg(F.when(r == 1, 1.0).otherwise(0.0)).alias("top1_share"), F.count_if(r.isNull()).alias("misses"), F.max(F.col("depth") * ms_per_row).alias("rerank_ms"),
    )


def judge_aggregate(samples: DataFrame, repeat: int) -> DataFrame:
    """id, the three medians, reasoning of the sample nearest to them (the first on ties), n_ok, error.

    samples: id, idx, the axes and reasoning; a failed sample has null axes. repeat must be odd; under
    half of it in successes is an error, and the medians are null."""
    if repeat % 2 == 0:
        raise ValueError("the number of samples must be odd")
    good = F.col(AXES[0]).isNotNull()
    medians = samples.groupBy("id").agg(*(F.median(a).alias(f"m_{a}") for a in AXES), F.count_if(good).alias("n_ok"))
    joined = samples.join(medians, "id").withColumn("distance", sum((F.abs(F.col(a) - F.col(f"m_{a}")) for a in AXES), F.lit(0.0)))
    near = joined.groupBy("id").agg(*(F.first(f"m_{a}").alias(a) for a in AXES), F.min_by("reasoning", F.when(good, F.struct("distance", "idx"))).alias("reasoning"), F.first("n_ok").alias("n_ok"))
    enough = F.col("n_ok") >= (repeat + 1) // 2
    return near.select("id", *(F.when(enough, F.col(a)).alias(a) for a in AXES), F.when(enough, F.col("reasoning")).alias("reasoning"), "n_ok", (~enough).alias("failed"))


def answer_summary(rows: DataFrame) -> DataFrame:
    """axis, score (1 to 5), n: zero-filled counts of each axis's scores."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(a, s) for a in AXES for s in range(1, 6)], "axis string, score int")
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("int").alias("score")) for a in AXES))).alias("x")).select("x.*")
    counts = long.groupBy("axis", "score").agg(F.count("*").alias("k"))
    return every.join(counts, ["axis", "score"], "left").select("axis", "score", F.coalesce("k", F.lit(0)).alias("n"))


def answer_means(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n and the mean of each axis (0 for none), median ms of those above 0 (0 for none)."""
    means = [F.coalesce(F.avg(a), F.lit(0.0)).alias(f"mean_{a}") for a in AXES]
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), *means)
    middle = medians(rows.withColumn("median_ms", F.when(F.col("answer_ms") > 0, F.col("answer_ms"))), ["median_ms"], by).withColumn("median_ms", F.coalesce("median_ms", F.lit(0.0)))
    return groups.join(middle.select(*(F.col(c).alias(f"_{c}") for c in by), "median_ms"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or None).drop(*(f"_{c}" for c in by))


def unstable(samples: DataFrame) -> DataFrame:
    """n_unstable: rows whose samples differ in sufficiency."""
    return samples.groupBy("id").agg(F.count_distinct("sufficiency").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_unstable"))


def worst_first(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the lowest least score, then sufficiency, then faithfulness."""
    return rows.orderBy(F.least(*AXES), "sufficiency", "faithfulness", "id").limit(most)


def dispersed(scores: DataFrame, score: str, by: str) -> DataFrame:
    """by, varied: whether the population deviation of scores is above 1e-6."""
    return scores.groupBy(by).agg((F.stddev_pop(score) > 1e-6).alias("varied"))


def gold_source(gold: DataFrame, chunks: DataFrame, unknown: str = "?") -> DataFrame:
    """gold with source: that of the smallest gold id, `unknown` where no chunk has it. gold: query_id, gold (array); chunks: id, source."""
    asked = gold.withColumn("_least", F.array_min("gold"))
    return asked.join(chunks.select(F.col("id").alias("_least"), "source"), "_least", "left").drop("_least").withColumn("source", F.coalesce("source", F.lit(unknown)))
