"""File sources and sinks: text corpora, chunk tables, JSON lines and reports."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import chunks, clean
from loomwork.operators.running import running_total
from loomwork.sources.shared import stored

GOLDEN = "id string, question string, reference_answer string, gold_chunk_ids array<long>, category string, difficulty string"


def text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """source (file name without .txt), text: one row for each *.txt file of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("source"), F.col("value").alias("text"))


def chunk_table(corpus: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, ordinal, meta, text: the chunks of each text; meta is chunk-<ordinal>."""
    found = corpus.select(key, F.posexplode(chunks(clean(F.col(text)))).alias("ordinal", "text"))
    return found.select(key, "ordinal", F.concat(F.lit("chunk-"), F.col("ordinal").cast("string")).alias("meta"), "text")


def with_chunk_ids(chunked: DataFrame, key: str = "source") -> DataFrame:
    """chunked with `id`: 1, 2, ... in the order of key and ordinal.

    The chunks are written once to the shared folder. A key's offset is the running sum of the chunks of the keys before it, over one row a key in spans
    of the order; within a key the ordinal is the place, so no window holds all chunks or all keys."""
    chunked = stored(chunked, "chunks")
    sizes = chunked.groupBy(key).agg(F.count("*").alias("n"))
    offsets = running_total(sizes, [key], F.col("n"), "offset").select(key, "offset")
    return chunked.join(offsets, key).withColumn("id", F.col("offset") + F.col("ordinal") + 1).drop("offset")


def rebuild_chunks(chunked: DataFrame, path: str) -> None:
    """Replaces the chunk table at path."""
    chunked.write.mode("overwrite").parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str = GOLDEN) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, a broken line or an empty file is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str, mode_column: str = "mode") -> None:
    """A folder for each mode, so that one mode's report never replaces another's."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(mode_column).json(path)


@dataclass(frozen=True)
class ResumeState:
    """What earlier runs have used: chunk ids, normalised questions, and the last number of each slug."""

    used_chunks: DataFrame
    seen_questions: DataFrame
    last_numbers: DataFrame


def resume_state(golden: DataFrame) -> ResumeState:
    from loomwork.functions.text import norm_ws

    number = golden.select(F.regexp_extract("id", r"^(.+)-(\d+)$", 1).alias("slug"), F.regexp_extract("id", r"^(.+)-(\d+)$", 2).alias("n")).filter("slug != ''")
    return ResumeState(
        golden.select(F.explode("gold_chunk_ids").alias("chunk_id")).distinct(),
        golden.select(norm_ws(F.coalesce("question", F.lit(""))).alias("question")).distinct(),
        number.groupBy("slug").agg(F.max(F.col("n").cast("int")).alias("last")),
    )


def read_int(value: str | None, fallback: int, least: int = 0) -> int:
    """An integer setting; the fallback where it is missing, no whole number, or below least. Blank counts as 0."""
    if value is None:
        return fallback
    text = value.strip() or "0"
    try:
        number = float(text)
    except ValueError:
        return fallback
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", text, re.IGNORECASE) or number != int(number) or number < least:
        return fallback
    return int(number)
