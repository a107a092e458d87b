"""Labelled rows for the classifiers: the training fold and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int) -> Column:
    """True for the rows whose crc32(doc_id as text) mod modulus is remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_labels(labels: DataFrame, column: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """doc_id, label of at most `most` rows outside the held-out fold, the ones of smallest hash.

    Null ids and labels are left out; the greatest label stands for a doc_id with several."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    rows = rows.filter(~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """text, label, one row for each sampled id; the sample is bounded by its own parameter, so it is broadcast.

    Where a doc_id repeats, its smallest text (nulls last) is the labelled one."""
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
