"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors are dealt into blocks of bounded size. In a block each vector x gets one more component, so that all have the
norm M of the longest; the squared distance to a query q (with 0 there) is then M^2 + |q|^2 - 2 q.x, so higher
scores are nearer rows and a window of scores is an annulus of distances. A tree splits rows by their
distance to a vantage point, in halves by rank, with the least and greatest distance of each half. By the triangle inequality
these bound the distance of a query to each leaf. Leaves that meet the annulus are read nearest first until k rows of a
fitting label are held and no unread leaf can hold a nearer one, or one as near. Scores are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import stored, whole_vectors

BLOCK_ROWS, ANCHOR_ROWS, LEAF_ROWS = 8192, 1024, 256


class Tree:
    """A vantage-point tree over the rows of one block; leaves are slices of `rows`, which is in tree order."""

    def __init__(self, rows: np.ndarray):
        squares = (rows * rows).sum(axis=1)
        self.square = float(squares.max(initial=0))  # M^2
        points = np.hstack([rows, np.sqrt(np.maximum(0, self.square - squares))[:, None]])
        self.place = np.arange(len(rows))  # of each row, before the tree
        self.vantage: list[int] = []
        self.steps: list[tuple[int, int, tuple[float, float], tuple[float, float]]] = []  # node, parent's slot, bounds of halves
        self.leaves: list[tuple[int, int, list[tuple[int, float, float]]]] = []
        self._split(points, 0, len(rows), [])
        self.rows, self.points = rows[self.place], points[self.vantage] if self.vantage else np.zeros((0, points.shape[1]))

    def _split(self, points: np.ndarray, begin: int, end: int, path: list[tuple[int, float, float]]) -> None:
        """path: for each vantage point above, its number and the least and greatest distance of the half this is in."""
        if end - begin <= LEAF_ROWS:
            if end > begin:
                self.leaves.append((begin, end, path))
            return
        held = self.place[begin:end]
        apart = lambda i: np.sqrt(((points[held] - points[i]) ** 2).sum(axis=1))
        chosen = held[int(apart(held[0]).argmax())]  # far from some row, so that distances to it spread
        distance = apart(chosen)
        order = np.argsort(distance, kind="stable")
        self.place[begin:end], distance = held[order], distance[order]
        node, middle = len(self.vantage), (end - begin) // 2
        self.vantage.append(int(chosen))
        self._split(points, begin, begin + middle, [*path, (node, distance[0], distance[middle - 1])])
        self._split(points, begin + middle, end, [*path, (node, distance[middle], distance[-1])])

    def reach(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest possible distance of each query to each leaf."""
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        squares = (lifted * lifted).sum(axis=1)
        to = np.sqrt(np.maximum(0, squares[:, None] + (self.points * self.points).sum(axis=1) - 2 * lifted @ self.points.T))
        low, high = np.zeros((len(queries), len(self.leaves))), np.full((len(queries), len(self.leaves)), np.inf)
        for i, (_, _, path) in enumerate(self.leaves):
            for node, near, far in path:
                low[:, i] = np.maximum(low[:, i], np.maximum(to[:, node] - far, near - to[:, node]))
                high[:, i] = np.minimum(high[:, i], to[:, node] + far)
        return low, high


class Search:
    """One query in one tree. Scores of leaves are computed once, for however many windows they are read."""

    def __init__(self, tree: Tree, query: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.tree, self.query, self.low, self.high = tree, query, low, high
        self.total = tree.square + float(query @ query)
        self.slack = 1e-7 * (1 + np.sqrt(self.total))  # distances are rounded roots of differences
        self.nearest_first = np.argsort(low, kind="stable")
        self.scores = np.full(len(tree.rows), np.nan)  # of rows of leaves that were read
        self.read = np.zeros(len(tree.leaves), dtype=bool)

    def distance(self, score: float) -> float:
        return float(np.sqrt(max(0.0, self.total - 2 * score)))

    def best(self, fits: np.ndarray, ids: np.ndarray, k: int, window: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (in tree order) and scores of the k best rows that fit and lie in the window of scores, ties by id."""
        least, most = window or (-np.inf, np.inf)
        if least > most:
            return np.empty(0, dtype=np.int64), np.empty(0)
        inner = self.distance(most) if window else 0.0
        outer = self.distance(least) if window else np.inf
        leaves = self.nearest_first[(self.low[self.nearest_first] <= outer + self.slack) & (self.high[self.nearest_first] >= inner - self.slack)]
        places, scores, at, step = np.empty(0, dtype=np.int64), np.empty(0), 0, 4
        while at < len(leaves) and not (len(places) == k and self.low[leaves[at]] > self.distance(scores[-1]) + self.slack):
            for leaf in leaves[at : at + step]:
                if not self.read[leaf]:
                    begin, end, _ = self.tree.leaves[leaf]
                    self.scores[begin:end] = self.tree.rows[begin:end] @ self.query
                    self.read[leaf] = True
            places = np.flatnonzero(fits & (self.scores >= least) & (self.scores <= most))
            scores = self.scores[places]
            if len(places) > k:  # ties with the k-th stay for the order by id
                best = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                places, scores = places[best], scores[best]
            top = np.lexsort((ids[places], -scores))[:k]
            places, scores, at, step = places[top], scores[top], at + step, 4 * step
        return places, scores


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, label, v: floor(scale * x) of each component as double, `row` a number of the row's own; written once.

    Rows with a null label, a null vector, or a null or non-finite component are left out."""
    kept = vectors.select("vec_id", "label", "embedding").filter("label is not null")
    schema = T.StructType([*kept.select("vec_id", "label").schema, T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, whole = whole_vectors(batch.column(2), scale)
            width, most = whole.shape[1], float(np.abs(whole).max(initial=0)) + 1
            if width * most * most >= 2**51:
                raise ValueError(f"components up to {most} of {width} dimensions: scores would not be exact")
            chosen = batch.select([0, 1]).take(pa.array(places))
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(places) * width + 1, width) if width else np.zeros(len(places) + 1), pa.int32()), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, v], ["vec_id", "label", "v"])

    return stored(kept.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "vectors")


def _nearest(rows: DataFrame, n: int, anchors: DataFrame, n_anchors: int, k: int, same: bool) -> DataFrame:
    """anchor, target, row, vec_id, score: of each block the k best rows of the anchor's label, or of other labels in each target's window.

    anchors: row, label, v, and targets: an array of (row, least, most). Each block of rows meets each block of anchors."""
    blocks, sets = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_anchors // ANCHOR_ROWS))
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("row", "vec_id", "label", "v", deal(blocks).alias("block"), every(sets).alias("set"))
    right = anchors.select("row", "label", "v", "targets", every(blocks).alias("block"), deal(sets).alias("set"))

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(held) and len(asked):
            tree = Tree(np.stack(held["v"]))
            in_order = held.iloc[tree.place]
            numbers, labels = in_order["row"].to_numpy(), in_order["label"].to_numpy()
            ids = in_order["vec_id"].astype("Int64")
            sort_ids = ids.fillna(np.iinfo(np.int64).max).to_numpy(dtype=np.int64)
            queries = np.stack(asked["v"])
            low, high = tree.reach(queries)
            for i, (row, label, targets) in enumerate(zip(asked["row"], asked["label"], asked["targets"], strict=True)):
                search, fits = Search(tree, queries[i], low[i], high[i]), (labels == label) == same
                if same:
                    fits &= numbers != row
                for target in targets:
                    places, scores = search.best(fits, sort_ids, k, None if same else (target["least"], target["most"]))
                    out.append((row, target["row"], places, scores))
        sizes = [len(x[2]) for x in out]
        found = np.concatenate([x[2] for x in out]) if out else np.empty(0, dtype=np.int64)
        columns = {"anchor": np.repeat([x[0] for x in out], sizes), "target": np.repeat([x[1] for x in out], sizes)}
        columns |= {"row": numbers[found] if out else found, "vec_id": pd.array(ids.iloc[found] if out else [], dtype="Int64")}
        return pd.DataFrame(columns | {"score": np.concatenate([x[3] for x in out]).astype(np.int64) if out else found})

    grouped = left.groupBy("block", "set").cogroup(right.groupBy("block", "set"))
    found = grouped.applyInPandas(run, "anchor long, target long, row long, vec_id long, score long")
    order = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, anchor_divisor: int = 100, n_positives: int = 5, k: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by anchor_divisor. An anchor's positives are its n_positives best other
    rows of its label; a positive's negatives the k best rows of other labels whose score is `least` to `most` hundredths of
    the positive's, both included. Best is by score, ties by smaller vec_id (nulls last).

    Rows with a null label, a null vector, or null or non-finite components take no part. Repeated rows are rows like
    others: each is an anchor of its own and may be another's positive. A row with a null vec_id is no anchor. A positive with a
    score below 0 has no negatives, one of 0 those of 0. An empty table, or one label alone, gives no rows. Vectors of
    different lengths, or so large that scores would not be exact, are a ValueError. Other columns are ignored."""
    rows = integer_rows(vectors, scale)
    asked = rows.filter(F.col("vec_id") % anchor_divisor == 0)
    n, n_anchors, shortest, longest = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % anchor_divisor == 0), F.min(F.size("v")), F.max(F.size("v"))).first()
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} and of {longest} components")
    nothing = F.array(F.struct(F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("most")))
    positives = stored(_nearest(rows, n, asked.select("row", "label", "v", nothing.alias("targets")), n_anchors, n_positives, True), "positives")
    low, high = F.ceil(F.col("score") * least / 100), F.floor(F.col("score") * most / 100)
    low = F.when(low * 100 < F.col("score") * least, low + 1).when((low - 1) * 100 >= F.col("score") * least, low - 1).otherwise(low)
    high = F.when(high * 100 > F.col("score") * most, high - 1).when((high + 1) * 100 <= F.col("score") * most, high + 1).otherwise(high)
    windows = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("row", low.alias("least"), high.alias("most"))).alias("targets"))
    ready = stored(asked.join(windows, "row").select("row", "vec_id", "label", "v", "targets"), "anchors")
    found = _nearest(rows, n, ready, n_anchors, k, False).select("anchor", "target", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("anchor", F.col("row").alias("target"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = ready.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(named, ["anchor", "target"]).join(anchors, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
