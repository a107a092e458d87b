"""Removal of repeated passages with prefix-partitioned suffix trees.

A window is `window` consecutive words of one document. Every word covered by a window whose
word sequence also starts earlier (smaller doc_id, or same document and earlier start) goes.

The suffix tree is sparse: it indexes suffixes around anchors only. A window's anchor is its smallest
(leftmost on ties) 6-word hash among the 15 that start in it; equal windows have equal anchors, so a
window can repeat only if its anchor occurs at least twice. One position in eight is an anchor.

How the suffixes are split into groups that fit in memory:
  * suffixes are dealt by the 6 words at their anchor, as long as no more than `group` anchors share those;
  * beyond that each suffix is dealt by its own prefix. Prefixes are counted at 8 and then at 12 words;
    one with more than `group` suffixes is lengthened, in the end to the whole window. A task first
    combines what it has itself, so a group of whole windows holds one suffix a task and window;
  * a group's suffixes are sorted by their words to the depth of a window, with the lengths of common
    prefixes between neighbours: that is its subtree. Internal nodes as deep as a window are
    the repeats, and every suffix below such a node but the earliest is marked. Neighbouring marked
    suffixes join to one maximal repeat.
Groups hold the words themselves. Inside one, words are numbered by hash, and every number is
confirmed on the words' bytes. Copies of a whole text are settled first, by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import KEY, keyed, small_batches, stored
from loomwork.llm.wordstream import SPACE, Words, chunks, grams

PREFIX = 6
LONGER = (8, 12)
CHUNK_WORDS = 400_000
HELD_WINDOWS = 50_000
SLICE_ROWS = 256
#: Anchors and prefixes that are too common are sent to every task; a group may grow so that there are no more of them (8 bytes each).
MOST_PREFIXES = 1_000_000
SALTS = 16


def anchors(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """text, anchor hash, anchor's word number, least and greatest distance of the windows that start before it."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    n = len(words.hash) - window + 1
    if n <= 0:
        return none
    g = grams(words.hash, PREFIX)
    span = window - PREFIX + 1
    at = np.arange(len(g))
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        width += step
    of = words.of_text()
    start = np.flatnonzero(of[:n] == of[window - 1 :])
    if not len(start):
        return none
    at = at[start]
    run = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(run[1:], len(at)) - 1
    text, place = of[at[run]], at[run]
    return text, g[place].view(np.int64), place - words.first[text], place - start[last], place - start[run]


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """anchor, the document's key, ref for each anchor of docs; ref packs its word number and the windows' distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in chunks(batch.column("text")):
                text, h, place, least, most = anchors(Words(data, offsets), window)
                if len(text):
                    ref = (place << 16) | (least << 8) | most
                    keys = [batch.column(c).take(pa.array(row + text)) for c in KEY]
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *keys, pa.array(ref, pa.int64())], names=["anchor", *KEY, "ref"])

    return docs.select(*KEY, "text").mapInArrow(run, "anchor long, no_id boolean, id long, mark long, ref long")


def heavy_prefixes(docs: DataFrame, deep: np.ndarray, window: int, group: int) -> dict[int, np.ndarray]:
    """For 8 and 12 words: the prefixes that more than `group` windows with a deep anchor begin with.

    deep: sorted anchors, whose number the caller bounds; so are the prefixes, as each has more than `group` windows."""
    lengths = [n for n in LONGER if n < window]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                text, h, place, least, most = anchors(words, window)
                some = np.isin(h, deep)
                if some.any():
                    begin, size = (words.first[text] + place - most)[some], (most - least + 1)[some]
                    starts = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    for length in lengths:
                        prefix, n = np.unique(grams(words.hash, length)[starts].view(np.int64), return_counts=True)
                        columns = [pa.array(np.full(len(n), length), pa.int32()), pa.array(prefix, pa.int64()), pa.array(n, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["length", "prefix", "n"])

    counts = docs.select("text").mapInArrow(run, "length int, prefix long, n long").groupBy("length", "prefix").agg(F.sum("n").alias("n"))
    got = counts.filter(F.col("n") > group).select("length", "prefix").toPandas()
    return {n: np.sort(got["prefix"][got["length"] == n].to_numpy(dtype=np.int64)) for n in lengths}


def _key_length(words: Words, starts: np.ndarray, heavy: dict[int, np.ndarray], window: int) -> np.ndarray:
    """The prefix length that each window is dealt by: the first whose group is not too large."""
    length = np.full(len(starts), window)
    open_ = np.ones(len(starts), dtype=bool)
    for n, many in heavy.items():
        light = open_ & ~np.isin(grams(words.hash, n)[starts].view(np.int64), many)
        length[light] = n
        open_ &= ~light
    return length


SUFFIXES = "prefix long, no_id boolean, id long, mark long, start int, windows int, words binary"
_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
_NAMES = ["prefix", *KEY, "start", "windows", "words"]


def suffix_rows(docs: DataFrame, window: int, heavy: dict[int, np.ndarray]) -> DataFrame:
    """What is dealt to the groups: for each repeated anchor the words of its windows.

    docs: key, row (with text), found (array of anchor, ref, deep). Rows whose words are null are windows
    already known to repeat an earlier one of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}  # of the deep windows of this task: key, start, prefix; HELD_WINDOWS and one text's at most

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

        def held() -> Iterator[pa.RecordBatch]:
            rows = [(prefix, *key, s, 1, words) for words, (key, s, prefix) in first.items()]
            first.clear()
            for i in range(0, len(rows), 10_000):
                yield out(rows[i : i + 10_000])

        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            rows: list[tuple] = []
            keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
            for key, text, found in zip(keys, batch.column("row").field("text"), batch.column("found").to_pylist(), strict=True):
                data, starts = text.as_py().encode(), []
                words = data.split()
                for x in found:
                    begin, end = (x["ref"] >> 16) - (x["ref"] & 255), (x["ref"] >> 16) - ((x["ref"] >> 8) & 255) + 1
                    if x["deep"]:
                        starts += range(begin, end)
                    else:
                        rows.append((x["anchor"], *key, begin, end - begin, b" ".join(words[begin : end + window - 1])))
                if starts:
                    measured, starts = Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])), np.array(starts)
                    length = _key_length(measured, starts, heavy, window)
                    prefix = np.zeros(len(starts), dtype=np.int64)
                    for n in np.unique(length):
                        prefix[length == n] = grams(measured.hash, int(n))[starts[length == n]].view(np.int64)
                    later = []
                    for s, p in zip(starts.tolist(), prefix.tolist(), strict=True):
                        whole, here = b" ".join(words[s : s + window]), (key, s, p)
                        there = first.setdefault(whole, here)
                        if there is here or there[:2] == here[:2]:
                            continue
                        if _order(there) <= _order(here):
                            if _order(there) < _order(here):
                                later.append(s)
                            continue
                        first[whole] = here
                        rows.append((there[0][2], *there[0], there[1], 1, None))
                    later.sort()
                    cut = np.flatnonzero(np.diff(np.array(later, dtype=np.int64), prepend=-9) != 1)
                    rows += [(key[2], *key, later[a], int(b - a), None) for a, b in zip(cut, [*cut[1:], len(later)][: len(cut)], strict=True)]
                if len(first) > HELD_WINDOWS:
                    yield from held()
            yield out(rows)
        yield from held()

    return docs.select(*KEY, "row", "found").mapInArrow(run, SUFFIXES)


def _order(place: tuple) -> tuple:
    """Documents by id, those without one last, then by start."""
    (no_id, id_, _), start = place[:2]
    return no_id, id_, start


def numbered(words: Words) -> np.ndarray:
    """A number for each word, the same for equal words: by hash, confirmed on the bytes."""
    _, first, rank = np.unique(words.hash, return_index=True, return_inverse=True)
    length = words.end - words.start
    same = length == length[first][rank]
    if same.all() and len(rank):  # each byte against that of the word's first occurrence
        at = np.flatnonzero(~SPACE[words.data])
        same = words.data[at] == words.data[at + np.repeat(words.start[first][rank] - words.start, length)]
    if same.all():
        return rank
    spelt = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    return np.unique(np.array(spelt, dtype=object), return_inverse=True)[1]


def subtree(words: list[bytes], windows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a group in the order of their words, and the words that each has in common with the one before.

    words: runs of words; windows: how many suffixes begin in each. Suffixes are read to `depth` words; their
    ranks at doubled depths give the order, and their common prefixes by halving."""
    data = b" ".join(words)
    offsets = np.append(0, np.cumsum([len(x) + 1 for x in words]))
    offsets[-1] -= 1
    read = Words(np.frombuffer(data, dtype=np.uint8), offsets)
    rank, step_to, ranks = numbered(read), 1, []
    while step_to < depth:  # ranks of suffixes to twice the depth, at last to the whole
        step = min(step_to, depth - step_to)
        ranks.append((step_to, rank))
        pair = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step_to += step
    row = np.repeat(np.arange(len(words)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = read.first[:-1][row] + nth
    order = np.argsort(rank[suffix], kind="stable")
    a, b = suffix[order[:-1]], suffix[order[1:]]
    common = np.where(rank[a] == rank[b], depth, 0)
    open_, done = np.flatnonzero(common == 0), np.zeros(len(a), dtype=np.int64)
    for size, at in reversed(ranks):
        x, y = a[open_] + done[open_], b[open_] + done[open_]
        fits = (np.maximum(x, y) < len(at)) & (done[open_] + size <= depth)
        same = np.zeros(len(open_), dtype=bool)
        same[fits] = at[x[fits]] == at[y[fits]]
        done[open_[same]] += size
    common[open_] = done[open_]
    return order, np.append(0, common)[: len(order)]


def repeated(no_id: np.ndarray, ids: np.ndarray, start: np.ndarray, windows: np.ndarray, words: list[bytes], window: int) -> np.ndarray:
    """Which suffixes of whole groups repeat an earlier one, as flags in the order of the rows' windows.

    A deep node is a run of neighbours in the subtree with a whole window in common."""
    order, common = subtree(words, windows, window)
    row = np.repeat(np.arange(len(words)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    node = np.empty(len(order), dtype=np.int64)
    node[order] = np.cumsum(common < window)
    begin = start[row] + nth
    by_age = np.lexsort((begin, ids[row], no_id[row], node))
    new = np.diff(node[by_age], prepend=-1) != 0
    oldest = by_age[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(row), dtype=bool)
    out[by_age] = (no_id[row][by_age] != no_id[row][oldest]) | (ids[row][by_age] != ids[row][oldest]) | (begin[by_age] != begin[oldest])
    return out


def repeats(suffixes: DataFrame, window: int) -> DataFrame:
    """The document's key, start, windows: maximal runs of windows of one suffix row that repeat an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        shown = [*KEY, "start", "windows"]

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            no_id, mark, start, windows = (table.column(c).to_numpy() for c in ("no_id", "mark", "start", "windows"))
            ids = np.where(no_id, 0, table.column("id").to_numpy())
            flag = repeated(no_id, ids, start, windows, table.column("words").to_pylist(), window)
            row = np.repeat(np.arange(len(ids)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            new = flag & ~(np.append(False, flag[:-1]) & (np.append(-1, row[:-1]) == row))
            number = np.cumsum(new)[flag] - 1
            first = np.flatnonzero(new)
            at = row[first]
            columns = (no_id[at], ids[at], mark[at], start[at] + nth[first], np.bincount(number, minlength=len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS[1:-1], strict=True)], names=shown)

        for batch in batches:
            known = batch.column("words").is_null()
            yield batch.filter(known).select(shown)
            batch = batch.filter(pa.array(~known.to_numpy(zero_copy_only=False)))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(batch.column("windows").to_numpy().sum()) + window * batch.num_rows
            if size >= CHUNK_WORDS:
                table = pa.Table.from_batches(held)
                prefix = table.column("prefix").to_numpy()
                cut = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on in the next batch
                if cut:
                    yield from done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(int(b.column("windows").to_numpy().sum()) + window * b.num_rows for b in held)
        if held:
            yield from done(pa.Table.from_batches(held))

    return suffixes.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "no_id boolean, id long, mark long, start int, windows int")


def _copies(texts: DataFrame) -> DataFrame:
    """Keys of documents whose whole text a document of smaller id has. Groups are met in SALTS parts, so a hot one is no single task."""
    digests = texts.filter("text is not null").select(*KEY, F.md5("text").alias("digest"))
    groups = digests.groupBy("digest").agg(F.min(F.struct("no_id", "id")).alias("rep"), F.count("*").alias("n")).filter("n > 1")
    salted = groups.select("digest", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = digests.withColumn("salt", F.pmod(F.xxhash64("id", "mark"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["digest", "salt"]).filter(F.struct("no_id", "id") > F.col("rep")).select(*KEY).distinct().withColumn("is_copy", F.lit(True))


def _marked(docs: DataFrame, window: int, group: int) -> DataFrame:
    """row (all columns of docs), is_copy, gone (array of start, windows) for each row of docs.

    Whole texts are dealt by document once; the scans and joins after that read the same shuffle."""
    small_batches(docs.sparkSession)
    base = keyed(docs.select(F.struct(*docs.columns).alias("row")), "row.doc_id", "row.text")
    base = base.join(_copies(base.select(*KEY, F.col("row.text").alias("text"))), KEY, "left")
    own = keyed(docs.select("doc_id", "text"), "doc_id", "text").filter("text is not null").select(*KEY, "text")

    rows = anchor_rows(own, window)
    # a table of its own, so that the join below is of two exchanges, whose skewed partitions Spark splits
    counts = stored(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    group = max(group, (counts.agg(F.sum("n")).first()[0] or 0) // MOST_PREFIXES)
    deep = np.array([r["anchor"] for r in counts.filter(F.col("n") > group).select("anchor").collect()], dtype=np.int64)  # MOST_PREFIXES at most
    heavy = heavy_prefixes(own, np.sort(deep), window, group) if len(deep) else {}
    found = rows.join(counts, "anchor").groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "ref", (F.col("n") > group).alias("deep"))).alias("found"))
    with_anchors = base.filter("is_copy is null").join(found, KEY)  # with the whole row, so that the shuffle of base is read again
    gone = repeats(suffix_rows(with_anchors, window, heavy), window).groupBy(*KEY).agg(F.collect_set(F.struct("start", "windows")).alias("gone"))
    return base.join(gone, KEY, "left").select("row", "is_copy", "gone")


def _kept_words(text: str | None, copy: bool, gone: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """How many words a text has, and those that stay."""
    words = (text or "").encode().split()
    n = len(words)
    if copy and n >= window:
        return n, []
    if not gone:
        return n, words
    mark = np.zeros(n + 1, dtype=np.int64)
    for x in gone:
        mark[x["start"]] += 1
        mark[x["start"] + x["windows"] + window - 1] -= 1
    return n, [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]


def remove_repeats(docs: DataFrame, window: int = 20, group: int = 2_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, if with_text) for every row of docs.

    docs: doc_id, text; other columns are ignored. A null text has no words. Texts shorter than a window
    stay whole. Rows of one doc_id are one document: neither is earlier than the other, so of equal
    windows in them only the later starts go, and rows with the same text have the same result.
    Rows with a null doc_id come after all others and are one document in that sense."""
    marked = _marked(docs.select("doc_id", "text"), window, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, texts = batch.column("row").flatten()
            n_words, n_removed, digest, kept_text = [], [], [], []
            for value, copy, gone in zip(texts, batch.column("is_copy").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                n, kept = _kept_words(value.as_py(), copy, gone, window)
                joined = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_text.append(joined.decode())
            columns = [doc_id, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept_text, pa.string())] if with_text else columns, names=[*names, "kept_text"] if with_text else names)

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def without_repeats(docs: DataFrame, window: int = 20, group: int = 2_000) -> DataFrame:
    """docs, all columns, with the words that stay as text. Rows that lose every word go; untouched texts stay as they are.

    Null and repeated ids as for remove_repeats. Whole texts cross the network once."""
    marked, names = _marked(docs, window, group), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            texts, stays = [], []
            for value, copy, gone in zip(columns[at], batch.column("is_copy").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text = value.as_py()
                if copy or gone:
                    n, kept = _kept_words(text, copy, gone, window)
                    if len(kept) < n:
                        text = b" ".join(kept).decode()
                    stays.append(bool(kept) or not n)
                else:
                    stays.append(True)
                texts.append(text)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    return marked.mapInArrow(run, docs.schema)
