"""Chat formatting by prefix-target expansion.

A conversation's turns, in order, are one text: `### role: text </turn>` and a line end for each turn. Each assistant
turn is an example of its own: its context is that text from the conversation's beginning up to the turn, and only
the reply is trainable. As all contexts of a conversation are prefixes of one text, the text is kept once, in blocks
of bounded numbers of turns, and an example is a span of it; `rendered` writes examples out whole.

Inside roles and texts a backslash comes before each backslash and hash sign, and between the two characters that would begin an end mark
(in roles also before each colon), so neither mark can occur there, and taking it away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import stored

BEGIN, BETWEEN, END = "### ", ": ", " </turn>\n"
#: Turns in a block, as a power of 2.
BLOCK_BITS = 6

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(x: Column, also: str = "") -> Column:
    return F.replace(F.regexp_replace(x, rf"[\\#{also}]", r"\\$0"), F.lit("</"), F.lit("<\\/"))


def unescaped(x: str) -> str:
    return _ESCAPED.sub(r"\1", x)


def formatted(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, block, text, n_turns, targets (begin and end of each trainable reply in the block's text, in code points).

    turns: conv_id, turn, role, text. Turns stand in the order of `turn` (nulls last), equal ones by role and text. A null role or
    text counts as empty; rows of a null conv_id are one conversation. Blocks ascend in the order of a conversation; other columns
    are ignored, an empty table gives no rows. Rows are sorted in ranges of conversation and turn, so a conversation
    with very many turns is many tasks' work; nothing but a block's turns is gathered."""
    whole = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = whole.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    mark = F.concat(F.lit(BEGIN), escaped(F.col("role"), ":"), F.lit(BETWEEN))
    shown = stored(placed.select("conv_id", "at", (F.col("role") == target_role).alias("target"), mark.alias("mark"), escaped(F.col("text")).alias("body")), "turns")
    grouped = shown.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "target", "mark", "body"))).alias("turns"))
    chars = F.transform("turns", lambda x: F.length(x["mark"]) + F.length(x["body"]) + len(END))
    before = lambda i: F.aggregate(F.slice("chars", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)
    span = lambda x, i: F.when(x["target"], F.struct((before(i) + F.length(x["mark"])).alias("begin"), (before(i) + F.length(x["mark"]) + F.length(x["body"])).alias("end")))
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["mark"], x["body"], F.lit(END))), "")
    targets = F.filter(F.transform("turns", span), lambda x: x.isNotNull())
    return stored(grouped.withColumn("chars", chars).select("conv_id", "block", text.alias("text"), F.size("turns").alias("n_turns"), targets.alias("targets")), "blocks")


def _placed(blocks: DataFrame) -> DataFrame:
    """conv_id, block, chars, n_targets, begin, first, last: of each block the code points and examples before it in its conversation.

    Sums run in ranges of blocks, then over one row a range, so no window holds a conversation."""
    sizes = blocks.select("conv_id", "block", F.length("text").cast("long").alias("chars"), F.size("targets").cast("long").alias("n_targets"))
    span = F.shiftright("block", 33 - BLOCK_BITS)
    names = ("chars", "n_targets")
    sums = sizes.groupBy(span.alias("span")).agg(*(F.sum(c).alias(c) for c in names))
    ahead = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("span", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in names))
    inside = Window.partitionBy("span").orderBy("block", "conv_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("span", span)
    inner = inner.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in names))
    total = inner.join(F.broadcast(offsets), "span")  # a row a range, of which there are as many as shuffle partitions
    total = stored(total.select("conv_id", "block", *names, *((F.col(f"{c}_ahead") + F.col(f"{c}_inside")).alias(f"{c}_before") for c in names)), "offsets")
    start = total.groupBy(F.col("conv_id").alias("_conv")).agg(*(F.min(f"{c}_before").alias(f"{c}_start") for c in names), F.max("block").alias("last"))
    joined = total.join(start, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", "block", *names, (F.col("chars_before") - F.col("chars_start")).alias("begin"), (F.col("n_targets_before") - F.col("n_targets_start")).alias("first"), (F.col("block") == F.col("last")).alias("last"))


def examples(blocks: DataFrame) -> DataFrame:
    """conv_id, example (from 1), block, loss_begin, loss_end, chars: one row for each assistant turn.

    Its text is the first `chars` code points of the conversation, its context what is before the turn, and only the code points from loss_begin
    up to loss_end are trainable. A conversation whose last turn is no reply has one more row, of the whole conversation, without
    example and loss."""
    spread = blocks.select("conv_id", "block", F.length("text").alias("size"), F.posexplode_outer("targets").alias("place", "target"))
    at = _placed(blocks).select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "begin", "first", "last", "chars")
    joined = spread.join(at, (F.col("block") == F.col("_block")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    of = F.col("begin")
    found = joined.filter("target is not null").select(
        "conv_id", (F.col("first") + F.col("place") + 1).alias("example"), "block", (of + F.col("target.begin")).alias("loss_begin"), (of + F.col("target.end")).alias("loss_end"),
        (of + F.col("target.end") + len(END)).alias("chars"),
    )
    ends = blocks.select("conv_id", "block", (F.coalesce(F.try_element_at("targets.end", F.lit(-1)) + len(END), F.lit(0)) == F.length("text")).alias("replied"))
    tails = ends.filter("not replied").join(at.filter("last"), (F.col("block") == F.col("_block")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    nothing = F.lit(None).cast("long")
    rest = tails.select("conv_id", nothing.alias("example"), "block", nothing.alias("loss_begin"), nothing.alias("loss_end"), (F.col("begin") + F.col("chars")).alias("chars"))
    return found.unionByName(rest)


def rendered(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_begin, loss_end: the chosen rows of `examples`, written out whole.

    This repeats a conversation's beginning in each of its examples, as training on them does; choose the rows of
    the shard that is to be written."""
    texts = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "text")
    joined = chosen.join(texts, (F.col("_block") <= F.col("block")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    whole = joined.groupBy("conv_id", "example", "loss_begin", "loss_end", "chars").agg(F.array_sort(F.collect_list(F.struct("_block", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    return whole.select("conv_id", "example", F.substring(text, F.lit(1), F.col("chars").cast("int")).alias("text"), "loss_begin", "loss_end")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of formatted text."""
    for turn in text.split(END)[:-1]:
        role, _, body = turn.removeprefix(BEGIN).partition(BETWEEN)
        yield unescaped(role), unescaped(body)


def read_back(blocks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its blocks.

    Digests go from block to block in a conversation's order, so a task holds one block and two digests. formatted_chars
    counts the texts of all examples (and of the row without a reply, see `examples`)."""
    schema = T.StructType([blocks.schema["conv_id"], *(T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, done = None, None, []
        for batch in batches:
            for key, text, targets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if held is None or key != conv:
                    if held is not None:
                        done.append((conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest()))
                    conv, held = key, [0, hashlib.sha256(), 0, hashlib.sha256()]
                whole = text.as_py()
                for role, body in turns_of(whole):
                    held[0] += 1
                    held[1].update(f"{role}\n{body}\n".encode())
                for span in targets.as_py():
                    reply = unescaped(whole[span["begin"] : span["end"]])
                    held[2] += len(reply)
                    held[3].update(reply.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=arrow)
                done = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest()), strict=True))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ordered = blocks.select("conv_id", "text", "targets", "block").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    read = ordered.mapInArrow(run, schema)
    chars = examples(blocks).groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("chars").alias("formatted_chars"))
    return read.join(chars, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
