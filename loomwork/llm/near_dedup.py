"""MinHash near-duplicate detection with HyperMinHash sketches.

A document's set is its distinct word shingles. The sketch splits the shingles' 64-bit hashes
into 128 buckets and keeps, for each bucket's smallest hash, its count of leading zeros (6 bits)
and the 10 bits after its first one: 2 bytes a register. Bands of 4 registers bring candidates
together; the estimate of Jaccard similarity, corrected for chance collisions, drops those that
are far below the threshold (six standard errors); the rest are confirmed on full shingle sets.

How groups of any size are handled:
  * equal sets collapse to one representative before banding, with map-side combining;
  * in a band, each document is first compared with the band's smallest document only;
  * documents of bands that are still in several components are sorted by their sketches, in
    several orders, and compared with those beside them: a bounded number each, whatever the band;
  * bands whose documents are then still in several components are compared by sketch, in tiles of
    bounded size, which give only enough pairs to connect what the sketches allow: the families;
  * a family's documents are compared on full sets, again in tiles, which give only enough links
    to join its components. So no step writes the pairs of a group.
Tiles leave out pairs within the largest component of a band or family: where g documents have r
outside of it, they take about (2 r g + r * r) / TILE rows.
No candidate is dropped by a cap. A link at similarity 0.85 is missed with probability
(1 - 0.85**4)**32, below 1e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import KEY, keyed, small_batches, stored
from loomwork.llm.wordstream import U, Words, chunks, grams, mix

BUCKET_BITS, ZERO_BITS, MANTISSA_BITS = 7, 6, 10
BUCKETS = 1 << BUCKET_BITS
ROWS_PER_BAND = 4
BANDS = BUCKETS // ROWS_PER_BAND
EMPTY = 0xFFFF
TILE = 512
ORDERS, BESIDE = 8, 2
CENTRE_ROWS = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased."""
    words = Words(data, offsets, lower=True)
    all_grams = grams(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_grams[a : b - k + 1]))
        elif b > a:
            out.append(grams(words.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes; EMPTY where a bucket has none."""
    out = np.full(BUCKETS, EMPTY, dtype=np.uint16)
    if len(hashes):
        bucket = (hashes >> U(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first of a bucket is its smallest
        rest = (hashes[first] << U(BUCKET_BITS)) | U(1 << (BUCKET_BITS - 1))
        zeros = 64 - np.frexp((rest >> U(11)).astype(np.float64))[1] - 11
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA_BITS)
        out[bucket[first]] = (zeros << MANTISSA_BITS) | mantissa.astype(np.int64)
    return out


#: By the logarithm of two sets' shingles in all: the mean width of a mantissa's cell, weighted by where the smaller of their smallest hashes falls.
LOG_SIZES = np.linspace(1, 48, 47 * 16 + 1)
_low, _rate = 2.0 ** -np.arange(1, 60), 2.0 ** LOG_SIZES[:, None] / BUCKETS
CELL_WIDTHS = (_low / 2**MANTISSA_BITS * (np.exp(-_rate * _low) - np.exp(-2 * _rate * _low))).sum(axis=1) / -np.expm1(-_rate[:, 0])


def collisions(n_a: np.ndarray | float, n_b: np.ndarray | float) -> np.ndarray:
    """The chance that a used register is equal for disjoint sets of n_a and n_b shingles.

    A bucket's smallest hash is exponential with the set's shingles a bucket as its rate; two of them
    fall into one cell with the product of their densities times the cell's width."""
    both = np.add(n_a, n_b, dtype=np.float64)
    return n_a / both * n_b / BUCKETS * np.interp(np.log2(both), LOG_SIZES, CELL_WIDTHS)


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray | float = 2.0**20, n_b: np.ndarray | float = 2.0**20) -> np.ndarray:
    """Jaccard estimates for rows of registers of sets of n_a and n_b shingles, corrected for the registers equal by chance."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=-1)
    n = np.maximum(used.sum(axis=-1), 1)
    chance = collisions(n_a, n_b)
    return (same / n - chance) / (1 - chance)


def least_estimate(threshold: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates below this are six standard errors under the threshold."""
    n = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=-1), 1)
    return threshold - 6 * np.sqrt(threshold * (1 - threshold) / n)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """The document's key, n_shingles, set_key (128 bits of the whole set), regs for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(row, end - row) for c in KEY),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=[*KEY, "n_shingles", "set_key", "regs"],
                )

    return docs.select(*KEY, "text").mapInArrow(run, "no_id boolean, id long, mark long, n_shingles long, set_key binary, regs binary")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), BUCKETS)


def plausible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, regs_a, regs_b, n_a, n_b) whose sizes and sketches allow the threshold: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _regs(batch.column("regs_a")), _regs(batch.column("regs_b"))
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                keep = (estimates(a, b, n_a, n_b) >= least_estimate(threshold, a, b)) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets.

    A centre a and its partners are dealt in parts of about CENTRE_ROWS, each with the centre's text once,
    so a hot centre is many tasks and no text travels once a pair. The numbers of parts are a table of their
    own: the pairs then meet it unaggregated, and Spark can split a hot centre in that join too."""
    sizes = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / CENTRE_ROWS).cast("int").alias("parts")), "parts")
    salted = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    partners = salted.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    centres = sizes.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    ordered = centres.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            b, keep, row = batch.column("b").to_pylist(), [], 0
            for _, _, data, offsets in chunks(batch.column("text")):
                for s in shingle_sets(data, offsets, k):
                    if b[row] is None:
                        centre = s
                        keep.append(False)
                    else:
                        both = np.intersect1d(centre, s, assume_unique=True).size
                        keep.append(100 * both >= percent * (len(centre) + len(s) - both))
                    row += 1
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of links (a, b).

    Each round takes the smallest label among a node and its neighbours, tells it to the node of the old
    label too, then takes the label of that label, and writes the labels to the shared folder. It ends when
    no label changes; the rounds grow with the logarithm of a chain's length."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        found = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("best"), F.col("component").alias("old"))
        told = F.array(F.struct("id", "best", "old"), F.struct(F.col("old").alias("id"), "best", F.lit(None).cast("long").alias("old")))
        best = found.select(F.inline(told)).groupBy("id").agg(F.min("best").alias("best"), F.max("old").alias("old"))
        up = labels.select(F.col("id").alias("best"), F.col("component").alias("above"))
        new = stored(best.join(up, "best").select("id", F.least("best", "above").alias("component"), "old"), "labels")
        if new.filter(F.col("component") != F.col("old")).isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def neighbours(members: DataFrame, threshold: float) -> DataFrame:
    """a, b: one pair for each two components with documents beside each other in an order of the sketches that allow the threshold.

    members: doc_id, component, n_shingles, regs. Each order starts at another band, so documents that agree there and
    further on stand together. A document gives at most ORDERS * BESIDE pairs. It only spares work: pairs that it does not see, such
    as those over two partitions, are left to the tiles."""
    start = F.col("turn") * (2 * BUCKETS // ORDERS)
    turned = members.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    turned = turned.select("turn", F.concat(F.substring("regs", start + 1, F.lit(2 * BUCKETS)), F.substring("regs", F.lit(1), start)).alias("regs"), "doc_id", "component", "n_shingles")
    ordered = turned.repartitionByRange("turn", "regs").sortWithinPartitions("turn", "regs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            held = rows[0].slice(max(rows[0].num_rows - BESIDE, 0))
            turn, doc, component, n = (rows[0].column(c).to_numpy() for c in ("turn", "doc_id", "component", "n_shingles"))
            regs = _regs(rows[0].column("regs"))
            for step in range(1, BESIDE + 1):
                i = np.flatnonzero((turn[step:] == turn[:-step]) & (component[step:] != component[:-step]))
                j = i + step
                likely = estimates(regs[i], regs[j], n[i], n[j])
                keep = (likely >= least_estimate(threshold, regs[i], regs[j])) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
                i, j, likely = i[keep], j[keep], likely[keep]
                columns = [f(x[i], x[j]) for x in (component, doc) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(likely)], names=["low", "high", "a", "b", "likely"])

    found = ordered.mapInArrow(run, "low long, high long, a long, b long, likely double")
    return found.groupBy("low", "high").agg(F.max(F.struct("likely", "a", "b")).alias("best")).select("best.a", "best.b")


def _by_tiles(members: DataFrame, key: str, carried: DataFrame, columns: list[str], pairs: Callable[[np.ndarray, list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """a, b: what `pairs` gives for each two tiles of each key's documents, but for tiles of its largest component, the main one.

    members: key, doc_id, component; carried: doc_id and what else `columns` name. A key's documents up to TILE are one
    tile. Of more, those outside the main component and those in it have tiles of their own; the former meet all,
    the latter only the former. A task holds two tiles at a time, whatever the key's size. pairs gets each row's tile and the rows."""
    members = stored(members, "members")
    counts = members.groupBy(key, "component").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(key).agg(F.sum("n").alias("size"), F.max("n").alias("main_size"), F.max_by("component", F.struct("n", "component")).alias("main")).filter("size > main_size")
    sizes = stored(sizes, "sizes")  # so that Spark can split a large key's members in the join
    few, inside = F.col("size") <= TILE, F.col("component") == F.col("main")
    n_out, n_main = (F.ceil(n / TILE).cast("int") for n in (F.col("size") - F.col("main_size"), F.col("main_size")))
    own = F.when(few, 0).when(inside, n_out + F.pmod(F.xxhash64("doc_id"), n_main)).otherwise(F.pmod(F.xxhash64("doc_id"), n_out)).cast("int")
    last = F.when(few, 0).when(inside, n_out - 1).otherwise(n_out + n_main - 1)
    placed = members.join(sizes, key).select(F.col(key).alias("key"), "doc_id", "component", own.alias("own"), last.alias("last"))
    spread = placed.join(carried, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    keyed = spread.select("key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", *columns)
    ordered = keyed.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, rows = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                found = pairs(np.array(own), rows)
                yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for group, t1, t2, tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, t1, t2) != at:
                    yield from done()
                    at, own, rows = (group, t1, t2), [], []
                own.append(tile)
                rows.append(tuple(row))
        yield from done()

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _spanning(own: np.ndarray, ids: np.ndarray, root: np.ndarray, n: np.ndarray, regs: np.ndarray, threshold: float, check: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs that join different roots, pass size, estimate and check; none that the pairs before make needless."""
    out, root, apart = [], root.copy(), own.min() != own.max()
    for i in range(len(ids)):
        at = np.flatnonzero((root != root[i]) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9))
        at = at[own[at] > own[i]] if apart else at[at > i]
        if len(at):
            likely = estimates(regs[at], regs[i], n[at], n[i])
            keep = likely >= least_estimate(threshold, regs[at], regs[i])
            at = at[keep][np.argsort(-likely[keep], kind="stable")]
        while len(at):
            j, at = at[0], at[1:]
            if check(i, j):
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                root[root == root[j]] = root[i]
                at = at[root[at] != root[i]]
    return out


def families(members: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of components, enough to connect all with documents whose sketches allow the threshold.

    members: band, doc_id, component; sketches: doc_id, n_shingles, regs. A band gives fewer pairs than it has documents."""

    def pairs(own: np.ndarray, rows: list[tuple]) -> list[tuple[int, int]]:
        order = sorted(range(len(rows)), key=lambda i: rows[i][1])  # the smallest component is tried first, in every band
        _, component, n, regs = zip(*(rows[i] for i in order), strict=True)
        regs = np.frombuffer(b"".join(regs), dtype=np.uint16).reshape(len(rows), BUCKETS)
        component = np.array(component)
        return _spanning(own[order], component, component, np.array(n), regs, threshold, lambda i, j: True)

    return _by_tiles(members, "band", sketches, ["doc_id", "component", "n_shingles", "regs"], pairs)


def links_within(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between different components of a family, confirmed on full sets, enough to join them.

    members: family, doc_id, component; texts: doc_id, text."""

    def pairs(own: np.ndarray, rows: list[tuple]) -> list[tuple[int, int]]:
        ids, component, texts = zip(*rows, strict=True)
        sets = []
        for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
            sets += shingle_sets(data, offsets, k)
        n = np.array([len(x) for x in sets])

        def linked(i: int, j: int) -> bool:
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            return 100 * both >= percent * (n[i] + n[j] - both)

        return _spanning(own, np.array(ids), np.array(component), n, np.array([registers(x) for x in sets]), percent / 100, linked)

    return _by_tiles(members, "family", texts, ["doc_id", "component", "text"], pairs)


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The key of each row of docs, n_shingles, and component, the number of its class (null without words).

    Equal sets are one node of the graph. A node's number is given when the table of nodes is written, so it stays."""
    small_batches(docs.sparkSession)
    threshold = percent / 100
    base = keyed(docs.select("doc_id", "text"), "doc_id", "text").select(*KEY, "text")
    sketches = stored(sketch(base, k), "sketches")
    full = sketches.filter("n_shingles > 0")
    least = full.groupBy("set_key").agg(F.min(F.struct(*KEY, "n_shingles", "regs")).alias("r")).select("set_key", "r.*")
    reps = stored(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = reps.select(F.col("node").alias("doc_id"), "n_shingles", "regs")

    none = F.lit(b"\xff" * (2 * ROWS_PER_BAND))
    part = lambda j: F.substring("regs", j * (2 * ROWS_PER_BAND) + 1, F.lit(2 * ROWS_PER_BAND))
    keys = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.when(part(j) != none, F.xxhash64(j, part(j)))), lambda x: x.isNotNull())
    bands = own.select("doc_id", F.explode(keys).alias("band"))
    shared = stored(bands.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).filter("size > 1"), "bands")
    members = bands.join(shared, "band")
    # only texts that share a band are ever compared: one pass over all texts picks them out
    met = reps.select(*KEY, "node").join(members.select(F.col("doc_id").alias("node")).distinct(), "node")
    texts = stored(base.groupBy(*KEY).agg(F.min("text").alias("text")).join(met, KEY).select(F.col("node").alias("doc_id"), "text"), "texts")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        side = lambda s: own.select(F.col("doc_id").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("n_shingles").alias(f"n_{s}"))
        return pairs.join(side("b"), "b").join(side("a"), "a")

    stars = members.filter("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = stored(confirmed(stored(plausible(with_sketches(stars), threshold), "pairs"), texts, k, percent), "links")
    joined = components(first)

    # bands whose documents are still in several components: first those beside each other, then what is left
    # apart. What the sketches allow makes families, and a family's documents are compared on full sets
    label = F.coalesce("component", "doc_id").alias("component")

    def apart(joined: DataFrame) -> DataFrame:
        labelled = members.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "doc_id", label)
        mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("band")
        return labelled.join(mixed, "band")

    beside = stored(neighbours(apart(joined).select("doc_id", "component").distinct().join(own, "doc_id"), threshold), "pairs")
    first = first.union(stored(confirmed(beside, texts, k, percent), "links"))
    joined = components(first)
    likely = stored(families(apart(joined), own, threshold), "likely")
    family = components(likely)
    grown = joined.join(family.select(F.col("id").alias("component"), F.col("component").alias("family")), "component").select("family", F.col("id").alias("doc_id"), "component")
    single = family.join(joined.select("id"), "id", "left_anti").select(F.col("component").alias("family"), F.col("id").alias("doc_id"), F.col("id").alias("component"))
    second = stored(links_within(grown.union(single), texts, k, percent), "links")
    joined = components(first.union(second))

    final = reps.select("set_key", F.col("node").alias("doc_id")).join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("set_key", label)
    alone = sketches.filter("n_shingles = 0").select(*KEY, "n_shingles", F.lit(None).cast("long").alias("component"))
    return full.select(*KEY, "n_shingles", "set_key").join(final, "set_key").drop("set_key").union(alone)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    docs: doc_id, text; other columns are ignored. A null or wordless text has an empty set and is
    linked with nothing. component_id is the smallest doc_id of the rows that links reach, null if
    none of them has an id. Rows of one doc_id are judged each by its own text, and all that have the
    component's id are kept. Without an id in its component a row is kept if no text there has a
    smaller hash. Equal texts are always linked. An empty table gives an empty result."""
    rows = stored(_classes(docs, k, percent), "classes")
    id_ = F.when(~F.col("no_id"), F.col("id"))
    # a table of its own, so that Spark can split the rows of a large component in the join
    least = stored(rows.filter("component is not null").groupBy("component").agg(F.min(id_).alias("component_id"), F.min("mark").alias("least")), "least")
    judged = rows.join(least, "component", "left").withColumn("doc_id", id_).withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    nameless = F.col("component").isNull() | (F.col("component_id").isNull() & (F.col("mark") == F.col("least")))
    kept = F.when(F.col("doc_id").isNull(), nameless).otherwise(F.col("doc_id") == F.col("component_id"))
    return judged.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each class: that of the smallest doc_id, and of several with it the one
    whose text has the smallest hash. Rows without an id come after all others.

    Rows that agree in id and text are repeats, of which the one with the smallest hash of all columns
    stays. Rows without words are linked with nothing, so all of them stay."""
    rows = _classes(docs, k, percent).groupBy(*KEY, "component").agg(F.count("*").alias("n"))
    first = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct(*KEY, "n")).alias("f")).select("f.*")
    kept = stored(first.union(rows.filter("component is null").select(*KEY, F.lit(1).cast("long"))), "kept")
    found = keyed(docs.select(F.struct(*docs.columns).alias("row")), "row.doc_id", "row.text").join(kept, KEY)
    out = found.filter("n = 1").select("row.*")
    if kept.filter("n > 1").isEmpty():
        return out
    hashed = F.xxhash64(*(F.col(f"row.{f.name}") for f in docs.schema if "map" not in f.dataType.simpleString()))
    return out.union(found.filter("n > 1").groupBy(*KEY).agg(F.min_by("row", hashed).alias("row")).select("row.*"))
