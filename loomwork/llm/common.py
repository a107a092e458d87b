"""What the operators of this subpackage share: table reads and tables in the shared folder."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.shared import shared_dir, stored

__all__ = ["KEY", "finite_vectors", "keyed", "shared_dir", "small_batches", "stored", "table", "whole_vectors"]

#: What tells documents apart where ids may be null or repeat: whether there is an id, the id, a hash of the text.
KEY = ["no_id", "id", "mark"]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with the columns of KEY. Rows of one id and one text have the same key."""
    return docs.withColumns({"no_id": F.col(doc_id).isNull(), "id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "mark": F.xxhash64(text)})


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most from now on in this session, as rows hold whole texts. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, "64m")
    if not re.fullmatch(r"\d{1,6}[kb]?|[1-7]m[b]?", held):
        spark.conf.set(name, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite_vectors(name: str) -> Column:
    """Whether a vector is not null and holds neither nulls nor numbers that are not finite."""
    return F.col(name).isNotNull() & F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_vectors(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that finite_vectors holds for, and floor(scale * x) of their components.

    Vectors of different lengths are a ValueError."""
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    sizes = pc.list_value_length(vectors).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    ends, faults = np.cumsum(sizes), np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = faults[ends] == faults[ends - sizes]
    widths = np.unique(sizes[good])
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} and of {widths[-1]} components")
    if not len(widths):
        return there[good], np.zeros((0, 0))
    whole = values[(ends - sizes)[good][:, None] + np.arange(widths[0])]
    return there[good], np.floor(whole * scale)
