"""Exact top-k by inner product with no-random-access aggregation.

Vectors are dealt into blocks of bounded size, queries likewise; a task gets one block of each. In a
block every dimension is a list sorted by its component. For a query the lists are read in step, from
the end that its component's sign makes the better one; known parts of scores are summed, and what a
row has not been met for is bounded above by the list's present value. Once the lists are half read the
leading rows' final scores give a lower bound of the k-th score, anew at each step. Reading stops when
unseen rows cannot reach that bound and few of those seen still can; these get their final scores.
The blocks' results, k rows a query and block at most, are ranked in the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v, n: floor(scale * x) of each component, x as double, and how many rows are alike in both.

    Rows with a null vec_id, a null vector, or a null or non-finite component are left out. Vectors so large that
    an inner product may not fit a long are a ValueError, as a wrapped score would be wrong."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    scaled = rows.select("vec_id", F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double")).alias("v"))
    most, width = scaled.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.max(F.size("v"))).first()
    if most is not None and width * (most + 1) ** 2 >= 2.0**63:
        raise ValueError(f"components up to {most} of {width} dimensions: inner products may not fit a long")
    return scaled.select("vec_id", F.transform("v", lambda x: F.floor(x)).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("n"))


class Lists:
    """One block's rows as one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.argsort(rows, axis=0, kind="stable")
        values = np.take_along_axis(rows, order, axis=0).astype(np.float64)
        # by direction (0 ascending, 1 descending), dimension, place
        self.order, self.values = np.stack([order.T, order.T[:, ::-1]]), np.stack([values.T, values.T[:, ::-1]])

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows; rows of the query's own id are left out."""
        use = np.flatnonzero(query)
        alive = np.flatnonzero(self.ids != query_id)
        if len(use) and len(alive) > k:
            alive = self.candidates(query, use, alive, k)
        score = self.rows[alive] @ query
        top = np.lexsort((self.ids[alive], -score))[:k]
        return alive[top], score[top]

    def candidates(self, query: np.ndarray, use: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
        """The rows of alive that bounds cannot rule out; query's components at `use` are not 0."""
        n, q = len(self.ids), query[use].astype(np.float64)
        way = (q > 0).astype(int)
        seen, unread = np.zeros(n), np.ones((n, len(use)))
        slack = 0.5 + 1e-12 * float(np.abs(q) @ np.abs(self.values[0, use]).max(axis=1))  # scores are whole; sums are rounded
        few, floor, step = max(4 * k, n // 32), -np.inf, max(16, n // 16)
        for begin in range(0, n, step):
            end = min(begin + step, n)
            met = self.order[way, use, begin:end]
            seen += np.bincount(met.ravel(), (self.values[way, use, begin:end] * q[:, None]).ravel(), minlength=n)
            unread[met, np.arange(len(use))[:, None]] = 0
            if 2 * end < n:
                continue
            lead = alive[np.argpartition(-seen[alive], min(2 * k, len(alive)) - 1)[: 2 * k]]
            floor = max(floor, np.partition(self.rows[lead] @ query, len(lead) - k)[len(lead) - k] - slack)
            now = self.values[way, use, end - 1] * q  # what each list has come to
            if now.sum() < floor:  # rows met nowhere are out
                alive = alive[seen[alive] + unread[alive] @ now >= floor]
                if len(alive) <= few:
                    break
        return alive


def top_k(vectors: DataFrame, query_divisor: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by query_divisor its k best others.

    Ties go to the smaller vec_id. A query with fewer others gets all of them. Rows that share a vec_id are rows
    like others, but never each other's results; as queries they share one list, the k best of all. Components that a
    shorter vector lacks count as 0. Extra columns are ignored; an empty table gives no rows. Every query
    meets every row, so rows are copied once for each QUERY_ROWS queries; equal rows travel as one."""
    rows = integer_vectors(vectors, scale)
    n = vectors.count()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // (QUERY_ROWS * query_divisor)))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    columns = lambda rows, b, qb, q: rows.select(F.lit(q).alias("is_query"), b.alias("block"), "vec_id", "v", "n").withColumn("query_block", qb)
    candidates = columns(rows, deal(blocks, 1), every(query_blocks), False)
    queries = columns(rows.filter(F.col("vec_id") % query_divisor == 0), every(blocks), deal(query_blocks, 2), True)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, part["v"]))
        both = np.zeros((len(part), width), dtype=np.int64)
        for i, v in enumerate(part["v"]):
            both[i, : len(v)] = v
        is_query, ids, copies = part["is_query"].to_numpy(), part["vec_id"].to_numpy(), part["n"].to_numpy()
        lists = Lists(ids[~is_query], both[~is_query]) if (~is_query).any() else None
        out = []
        for i in np.flatnonzero(is_query) if lists else []:
            found, score = lists.best(ids[i], both[i], k)
            out.append(pd.DataFrame({"query_id": ids[i], "vec_id": lists.ids[found], "score": score, "times": np.minimum(copies[~is_query][found] * copies[i], k)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "times": []}, dtype="int64")

    scored = candidates.unionByName(queries).groupBy("block", "query_block").applyInPandas(run, "query_id long, vec_id long, score long, times long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    spread = scored.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
    return spread.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
