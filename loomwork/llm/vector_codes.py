"""Product codes of vectors: each vector as the indexes of its parts' nearest codebook entries.

Codebooks are refined in rounds over all rows. An entry is searched by annular norm pruning: entries are
sorted by norm; whatever lies at a distance d from a part has a norm within d of the part's own, so the best
distance met so far allows an interval of norms, found by binary search with both ends included, and only
entries in that annulus are compared exactly. Numbers are whole, so distances and ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import finite_vectors, stored, whole_vectors
from loomwork.sources.shared import small

#: Parts that are searched together, which are near in norm, and entries that give them a first distance.
TOGETHER, FIRST = 64, 16


class Codebook:
    """The entries (whole numbers) of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(squares, kind="stable")
        self.entries, self.squares = entries[self.order], squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.compared = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each part's nearest entry, the lower one on ties, and its squared distance."""
        squares = (parts * parts).sum(axis=1)
        norms = np.sqrt(squares.astype(np.float64))
        index, least = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        by_norm, n = np.argsort(norms, kind="stable"), len(self.norms)
        for begin in range(0, len(parts), TOGETHER):
            rows = by_norm[begin : begin + TOGETHER]
            p, r = parts[rows], norms[rows]

            def distances(low: int, high: int, p=p, own=squares[rows]) -> np.ndarray:
                self.compared += len(p) * (high - low)
                return own[:, None] + self.squares[low:high] - 2 * (p @ self.entries[low:high].T)

            middle = int(np.searchsorted(self.norms, r[len(r) // 2])) - FIRST // 2
            first = max(0, min(middle, n - FIRST))
            best = np.sqrt(distances(first, min(n, first + FIRST)).min(axis=1).astype(np.float64))
            best += 1e-9 * (1 + best + r)  # roots are rounded
            low, high = np.searchsorted(self.norms, r - best, "left"), np.searchsorted(self.norms, r + best, "right")
            begin_at, end_at = int(low.min()), int(high.max())
            d = distances(begin_at, end_at)
            place = np.arange(begin_at, end_at)
            inside = (place >= low[:, None]) & (place < high[:, None])
            nearest = np.where(inside, d, d.max() + 1).min(axis=1)
            index[rows] = np.where(inside & (d == nearest[:, None]), self.order[begin_at:end_at], n).min(axis=1)
            least[rows] = nearest
        return index, least


def _parts(vectors: np.ndarray, n_parts: int) -> list[np.ndarray]:
    """The vectors cut into parts, in a type in which their distances are exact."""
    width = vectors.shape[1]
    if width % n_parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {n_parts} equal parts")
    most = int(np.abs(vectors).max(initial=0)) + 1
    if 4 * width * most * most >= 2**62:
        raise ValueError(f"components up to {most}: distances may not fit a long")
    kind = np.float64 if 4 * width * most * most < 2**52 else np.int64
    return [np.ascontiguousarray(x) for x in np.split(vectors.astype(kind), n_parts, axis=1)]


def _books(codebooks: list[np.ndarray], like: np.ndarray) -> list[Codebook]:
    return [Codebook(x.astype(like.dtype)) for x in codebooks]


def _checked(vectors: np.ndarray, codebooks: list[np.ndarray]) -> np.ndarray:
    width = sum(x.shape[1] for x in codebooks)
    if vectors.shape[1] != width:
        raise ValueError(f"vectors of {vectors.shape[1]} and of {width} components")
    return vectors


def first_codebooks(vectors: DataFrame, n_parts: int = 4, size: int = 256, scale: int = 1024) -> list[np.ndarray]:
    """The parts of the `size` rows of the smallest vec_ids (nulls last, equal ids by vector), ascending."""
    rows = vectors.select("vec_id", "embedding").filter(finite_vectors("embedding"))
    chosen = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(size).collect()
    if not chosen:
        return []
    kept, whole = whole_vectors(pa.array([r["embedding"] for r in chosen], pa.list_(pa.float64())), scale)
    return [x.astype(np.int64) for x in _parts(whole, n_parts)]


def refined(vectors: DataFrame, codebooks: list[np.ndarray], scale: int = 1024) -> list[np.ndarray]:
    """One round: each entry becomes the floor of the mean of the parts nearest to it; unused entries stay.

    A task sums its own rows first, so what is shuffled is a row for each task, entry and component, and
    what reaches the driver has the size of the codebooks."""
    n_parts = len(codebooks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(x.shape, dtype=np.int64) for x in codebooks]
        count = [np.zeros(len(x), dtype=np.int64) for x in codebooks]
        for batch in batches:
            kept, whole = whole_vectors(batch.column(0), scale)
            if not len(kept):
                continue
            parts = _parts(_checked(whole, codebooks), n_parts)
            for i, (part, book) in enumerate(zip(parts, _books(codebooks, parts[0]), strict=True)):
                index, _ = book.nearest(part)
                np.add.at(total[i], index, part.astype(np.int64))
                count[i] += np.bincount(index, minlength=len(count[i]))
        used = [(i, j) for i in range(n_parts) for j in np.flatnonzero(count[i])]
        columns = [[i for i, _ in used], [j for _, j in used], [count[i][j] for i, j in used], [total[i][j] for i, j in used]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "n", "sums"])

    found = vectors.select("embedding").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    spread = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
    out = [x.copy() for x in codebooks]
    for r in spread.groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
    return out


def trained(vectors: DataFrame, n_parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> list[np.ndarray]:
    """The codebook of each part position after `rounds` rounds over all rows; none for no rows."""
    codebooks = first_codebooks(vectors, n_parts, size, scale)
    for _ in range(rounds if codebooks else 0):
        codebooks = refined(vectors, codebooks, scale)
    return codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, codebooks: list[np.ndarray], scale: int = 1024) -> DataFrame:
    """vec_id, label, code (an index for each part, in hex), error (the parts' squared distances summed)."""
    digits = max([2, *(len(f"{len(x) - 1:x}") for x in codebooks)])
    rows = vectors.select("vec_id", "label", "embedding")
    schema = T.StructType([*rows.select("vec_id", "label").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = whole_vectors(batch.column(2), scale)
            if not len(kept):
                continue
            parts = _parts(_checked(whole, codebooks), len(codebooks))
            found = [book.nearest(part) for part, book in zip(parts, _books(codebooks, parts[0]), strict=True)]
            names = [np.char.zfill([f"{j:x}" for j in range(len(x))], digits).astype(object) for x in codebooks]
            code = names[0][found[0][0]]
            for i in range(1, len(found)):
                code = code + names[i][found[i][0]]
            error = np.sum([d for _, d in found], axis=0)
            chosen = batch.select([0, 1]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def compressed(vectors: DataFrame, n_parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error (error over equal labels, nulls together), codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out. All others take part, each
    for itself, also those with a null or repeated vec_id. Fewer rows than `size` give smaller codebooks; an empty table gives
    no rows. Kept vectors of different lengths, of a length that cannot be cut, or so large that distances may
    not fit a long are a ValueError. Other columns are ignored."""
    codebooks = trained(vectors, n_parts, size, rounds, scale)
    found = stored(coded(vectors, codebooks, scale), "codes") if codebooks else coded(vectors.limit(0), codebooks, scale)
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = found.join(small(by_label), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
