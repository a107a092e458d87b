"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Null and repeated doc_ids are rows like others in every stage; rows that agree in id and text are one
document for near-dedup, which keeps one of them. Null and empty texts stay until the mix, which takes words only.
Columns besides those of documents go through unchanged until the last stage. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import pieces, toxicity
from loomwork.llm.common import stored, table
from loomwork.llm.mixing import mixed
from loomwork.llm.near_dedup import without_copies
from loomwork.llm.queries import PIECE_MODEL
from loomwork.llm.substring_dedup import without_repeats as without_passages


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, trained on the labelled ones, does not reject."""
    return toxicity.without_toxic(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 of 5-word shingles: the smallest doc_id's."""
    return without_copies(docs, k=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier; one that loses all words goes."""
    return _with_length(without_passages(docs, window=20), docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each use of a document, which is used whole."""
    return mixed(docs).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every use in the mix."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", mixed_sources),
    ("sentencepiece", encoded),
]

#: The learned toxicity grammar and piece encoding have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
