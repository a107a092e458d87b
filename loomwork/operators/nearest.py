"""Best rows by dot product, in blocks: vectors and queries are packed as bytes, and a block of one times a block of the
other is one matrix product in a task, of which only the best rows of each query go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.sources.shared import MOST_BROADCAST_ROWS, stored

#: Vectors and queries in a block.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Blocks of queries whose best rows a task holds.
HELD = 64


def _packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """keys (array), width, data (little-endian floats as wide as the column's): `size` vectors a row at most, null ones left out."""
    wide = isinstance(rows.schema[vector].dataType.elementType, T.FloatType)
    kind, arrow = ("<f4", pa.float32()) if wide else ("<f8", pa.float64())
    key_type = rows.schema[key].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(key_type)), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                widths = pc.unique(pc.list_value_length(part.column(1))).to_pylist()
                if len(widths) > 1:
                    raise ValueError(f"vectors have {min(widths)} to {max(widths)} numbers")
                data = part.column(1).flatten().cast(arrow).to_numpy(zero_copy_only=False).astype(kind).tobytes()
                keys = pa.ListArray.from_arrays([0, part.num_rows], part.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array(widths, pa.int32()), pa.array([data], pa.binary())], schema.names)

    return rows.select(key, vector).mapInArrow(pack, schema).withColumn("kind", F.lit(kind))


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query_id, id, score (dot product, in double), rank by score rounded to 9 digits, then id. The packed vectors are written to the shared folder.

    vectors: id, v; queries: query_id, q; null vectors take no part, different lengths are an error. The stated queries meet every
    vector, a block with a block. Few queries go to all tasks, as a count shows when this is built; else both sides are
    dealt into as many buckets as there are shuffle partitions, with the queries in each. What goes on is `most` rows
    of a query and task."""
    spark, wanted = vectors.sparkSession, max(most, 0)
    few = queries.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS
    buckets = 1 if few else int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = stored(_packed(vectors, "id", "v", BLOCK_ROWS), "packed").withColumn("bucket", F.pmod(F.xxhash64("keys"), F.lit(buckets)))
    asked = _packed(queries.repartition(1) if few else queries, "query_id", "q", QUERY_ROWS).withColumn("block", F.monotonically_increasing_id())
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    asked = asked.select("bucket", *(F.col(c).alias(f"q_{c}") for c in ("keys", "width", "data", "kind", "block")))
    if few:  # a task for each full block, however small the pieces that the vectors came in
        held = held.coalesce(max(1, -(-(held.agg(F.sum(F.size("keys"))).first()[0] or 0) // BLOCK_ROWS)))
    pairs = held.join(F.broadcast(asked) if few else asked, "bucket").select("keys", "width", "data", "kind", "q_keys", "q_width", "q_data", "q_kind", "q_block")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]] = {}  # by block of queries: its keys, and row, id, score of the best so far

        def rows(q_keys: pa.Array, row: np.ndarray, ids: pa.Array, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([q_keys.take(pa.array(row)), ids, pa.array(score)], schema.names)

        for batch in batches:
            for i in range(batch.num_rows if wanted else 0):
                keys, q_keys = batch.column(0)[i].values, batch.column(4)[i].values
                width, data, kind, q_width, q_data, q_kind, name = (batch.column(c)[i].as_py() for c in (1, 2, 3, 5, 6, 7, 8))
                if width != q_width:
                    raise ValueError(f"vectors have {width} numbers, queries {q_width}")
                v = np.frombuffer(data, kind).reshape(len(keys), width).astype(np.float64)
                q = np.frombuffer(q_data, q_kind).reshape(len(q_keys), width).astype(np.float64)
                score = np.round(q @ v.T, 9) + 0.0
                score[np.isnan(score)] = -np.inf
                k = min(wanted, len(keys))
                kth = np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k]
                row, column = np.nonzero((score >= kth[:, None]) & np.isfinite(score))  # with all that are level with the k-th
                whole, ids = (q[row] * v[column]).sum(axis=1), keys.take(pa.array(column))
                if name in best:
                    _, row_before, ids_before, score_before = best[name]
                    row, ids, whole = np.concatenate([row_before, row]), pa.concat_arrays([ids_before, ids]), np.concatenate([score_before, whole])
                order = np.lexsort((pc.rank(ids).to_numpy(), -np.round(whole, 9), row))
                row = row[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < wanted
                best[name] = q_keys, row[kept], ids.take(pa.array(order[kept])), whole[order][kept]
                if len(best) > HELD:
                    yield rows(*best.pop(next(iter(best))))
        for entry in best.values():
            yield rows(*entry)

    scores = pairs.mapInArrow(products, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)
