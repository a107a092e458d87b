"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

The mix is a number of equal blocks of tokens. Sources get blocks by the highest quotients of their
targets, and each source's blocks go to its shards by the highest quotients of their sizes. In a
shard a seeded hash orders the documents; the quota takes the blocks from the start of that
order, and from the start again once the shard is used up. So a shard gives exactly its quota, of
one or two documents only a part, and no document more than twice. `mixed` uses documents whole.

Shards hold about `shard_rows` documents, so a source of any size is many tasks. Tables of one row
a source are ordered in a single task; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import stored

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST_USES = 2
WORD = r"[^\x20\x09-\x0D]+"


def _highest_quotients(parties: DataFrame, group: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """parties with `quota`: seats of their group by Sainte-Laguë, ties to the first in order.

    By the divisor's bounds a party gets its share, lowered or raised by parties / (2 seats) of it, to
    within one half; only the seats in doubt are listed and ranked, a few for each party."""
    whole = Window.partitionBy(*group)
    share = F.col(weight) / F.col("_sum") * F.col(seats)
    slack = share * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))
    counted = parties.withColumn("_sum", F.greatest(F.sum(weight).over(whole).cast("double"), F.lit(1e-9))).withColumn("_n", F.count(F.lit(1)).over(whole))
    bounded = counted.withColumn("_sure", F.greatest(F.floor(share - slack - 0.5), F.lit(0))).withColumn("_top", F.ceil(share + slack + 0.5) + 1)
    bounded = bounded.withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
    seat = bounded.select(*group, *order, weight, "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_top"))).alias("_k"))
    ranked = seat.withColumn("_r", F.row_number().over(whole.orderBy(F.desc(F.col(weight) / (2 * F.col("_k") - 1)), *order, "_k")))
    won = ranked.filter((F.col("_r") <= F.col("_left")) & (F.col(weight) > 0)).groupBy(*group, *order).agg(F.count("*").alias("_won"))
    keys = [*dict.fromkeys([*group, *order])]
    return bounded.join(won, keys, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sum", "_n", "_sure", "_top", "_left", "_won")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, rank (from 1, by code point, null last), source_size, n_docs, total, target.

    A target is the weight's share of EPOCHS times all sizes, at most MOST_USES times the source's size;
    what that cuts off is shared by weight among the others, until none is above."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = per.withColumn("rank", rank).withColumn("w", weight.cast("double")).withColumn("total", F.sum("source_size").over(everything))
    ranked = ranked.withColumn("most", (F.lit(MOST_USES) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)), F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))
    level = (EPOCHS * F.col("total") - spent) / (F.sum("w").over(everything) - gone)
    levels = ranked.withColumn("level", level)
    free = F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))
    final = F.min_by(free, F.when(free.isNotNull(), F.struct(F.col("most") / F.col("w"), F.col("rank")))).over(everything)
    return levels.select("source", "rank", "source_size", "n_docs", "total", F.coalesce(F.least("most", F.col("w") * final), F.col("most")).alias("target"))


def mix(docs: DataFrame, block: int = 4, shard_rows: int = 2000, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    size counts the words of text (null: 0); taken counts the words the mix takes, repeats included. A
    null source is a source of its own; null and repeated doc_ids are rows like others, told apart by
    their size and a hash of their text in the seeded order. Extra columns are ignored; an empty table
    gives no rows, and with no word at all every number is 0."""
    sizes = stored(_sized(docs), "sizes")
    return _taken(sizes, sizes, block, shard_rows, seed).select("doc_id", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark"))


def _hash(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _taken(rows: DataFrame, sizes: DataFrame, block: int, shard_rows: int, seed: str) -> DataFrame:
    """rows (doc_id, source, size, mark, ...) with what the mix of all sizes takes of each. Rows are dealt by shard once."""
    targets = source_targets(sizes).withColumn("blocks", F.round(EPOCHS * F.col("total") / block).cast("long")).withColumn("all", F.lit(1))
    sources = _highest_quotients(targets, ["all"], ["rank"], "target", "blocks")
    sources = sources.select(F.col("source").alias("of"), "rank", "source_size", "target", F.ceil(F.col("n_docs") / shard_rows).alias("shards"), F.col("quota").alias("blocks"))

    def placed(part: DataFrame) -> DataFrame:
        found = part.join(sources, part.source.eqNullSafe(sources.of)).withColumn("h", _hash(seed))
        return found.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.col("shards")))

    shards = placed(sizes).groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = _highest_quotients(shards, ["rank"], ["shard"], "shard_size", "blocks").select("rank", "shard", "shard_size", (F.col("quota") * block).alias("quota"))
    before = Window.partitionBy("rank", "shard").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    out = placed(rows).join(quotas, ["rank", "shard"]).withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
    used = lambda n: F.greatest(F.least(F.col("begin") + F.col("size"), n) - F.col("begin"), F.lit(0))
    return out.withColumn("taken", sum((used(F.col("quota") - i * F.col("shard_size")) for i in range(MOST_USES)), F.lit(0)).cast("long"))


def mixed(docs: DataFrame, block: int = 4, shard_rows: int = 2000, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of docs, whole, once for each use.

    A document is used as often as the words that `mix` takes of it are times its size, to the nearest
    whole number, so a shard's words are its quota to within half of two documents. A document that the mix
    does not take is not in it, nor one without words. Null and repeated doc_ids are rows like others."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    sizes = stored(_sized(docs), "sizes")
    columns = [c.alias(n) for n, c in zip(("doc_id", "source", "size", "mark"), (F.col("row.doc_id"), F.col("row.source"), F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long"), F.xxhash64("row.text")), strict=True)]
    taken = _taken(rows.select("row", *columns), sizes, block, shard_rows, seed).filter("taken > 0")
    uses = F.round(F.col("taken") / F.col("size")).cast("int")
    return taken.filter(uses > 0).select("row", F.explode(F.sequence(F.lit(1), uses)).alias("use")).select("row.*")
