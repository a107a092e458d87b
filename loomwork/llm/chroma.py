"""Audio fingerprints of media columns: chroma, integral-image filters, packed integers, alignment by offset histogram.

Recordings are 16-bit mono PCM. Frames give energies of the twelve pitch classes; filters over
rectangles of the chroma image, read from its integral image, are cut into four levels each by
quartiles over all recordings and packed, 2 bits a filter, into one 32-bit integer a frame. Two
recordings are compared at the offsets that integers with two equal bytes vote for, by the share of
differing bits where they overlap, and aligned at the one with most votes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import stored

RATE, FRAME, HOP = 4000, 1024, 256
LOWEST, HIGHEST = 110.0, 1760.0
#: Filters by rule: four shapes (whole, split in time, split in pitch, checked) at four widths and pitch bands.
FILTERS = [(shape, width, low, rows) for width, low, rows in ((2, 0, 4), (4, 4, 4), (8, 8, 4), (6, 0, 12)) for shape in ("whole", "time", "pitch", "both")]
WIDEST = max(f[1] for f in FILTERS)


def _bank() -> np.ndarray:
    """Which pitch class each frequency of a frame's spectrum counts for."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (hz >= LOWEST) & (hz <= HIGHEST)
    pitch = np.zeros(len(hz), dtype=int)
    pitch[used] = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    bank = np.zeros((len(hz), 12))
    bank[np.flatnonzero(used), pitch[used]] = 1
    return bank


_BANK, _TAPER = _bank(), np.hanning(FRAME)


#: Frames whose spectra are held at once.
FRAMES = 256


def chroma(pcm: bytes | None) -> np.ndarray:
    """Frames by 12 shares of energy; none for audio shorter than a frame."""
    return chromas(np.frombuffer((pcm or b"")[: len(pcm or b"") // 2 * 2], dtype="<i2")[None])[0]


def chromas(signals: np.ndarray) -> np.ndarray:
    """`chroma` of recordings of one length, a row each. Spectra go to the same arrays again and again, as new ones would cost more than the work on them."""
    n = max(0, (signals.shape[1] - FRAME) // HOP + 1)
    energy, most = np.zeros((len(signals), n, 12)), min(n, FRAMES)
    tapered, spectrum, power = np.empty((most, FRAME)), np.empty((most, len(_BANK)), complex), np.empty((most, len(_BANK)))
    frames = np.lib.stride_tricks.sliding_window_view(signals.astype(np.float64), FRAME, axis=1)[:, ::HOP] if n else ()
    for own, framed in zip(energy, frames, strict=n > 0):
        for begin in range(0, n, FRAMES):
            of = slice(0, min(FRAMES, n - begin))
            np.multiply(framed[begin : begin + FRAMES], _TAPER, out=tapered[of])
            np.fft.rfft(tapered[of], out=spectrum[of])
            np.square(np.abs(spectrum[of], out=power[of]), out=power[of])
            np.matmul(power[of], _BANK, out=own[begin : begin + FRAMES])
    total = energy.sum(axis=-1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 0)


def responses(image: np.ndarray) -> np.ndarray:
    """One row a position, one column a filter: log ratios of the two halves' sums. image may be several of one length, and gives as many."""
    several, n = image.shape[:-2], image.shape[-2] - WIDEST + 1
    if n < 1:
        return np.zeros((*several, 0, len(FILTERS)))
    whole = np.zeros((*several, image.shape[-2] + 1, 13))
    whole[..., 1:, 1:] = image.cumsum(axis=-2).cumsum(axis=-1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return whole[..., t1 : t1 + n, p1] - whole[..., t0 : t0 + n, p1] - whole[..., t1 : t1 + n, p0] + whole[..., t0 : t0 + n, p0]

    plus, minus = np.empty((len(FILTERS), *several, n)), np.empty((len(FILTERS), *several, n))
    for k, (shape, w, low, rows) in enumerate(FILTERS):
        high, t, p = low + rows, w // 2, low + rows // 2
        all_ = area(0, w, low, high)
        if shape == "whole":
            plus[k], minus[k] = all_, w * rows / 12.0
            continue
        if shape == "time":
            plus[k] = area(0, t, low, high)
        elif shape == "pitch":
            plus[k] = area(0, w, low, p)
        else:
            plus[k] = area(0, t, low, p) + area(t, w, p, high)
        minus[k] = all_ - plus[k]
    return np.moveaxis(np.log((1 + np.maximum(plus, 0)) / (1 + np.maximum(minus, 0))), 0, -1)


def pack(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """32-bit integers; neighbouring levels differ in one bit. levels: three cuts for each filter."""
    level = (values > levels[:, 0]).astype(np.uint32) + (values > levels[:, 1]) + (values > levels[:, 2])
    gray = level ^ (level >> 1)
    return (gray << (2 * np.arange(len(FILTERS), dtype=np.uint32))).sum(axis=-1, dtype=np.uint32)


#: Samples of recordings that are turned into responses at once; one recording at least.
SAMPLES = 400_000


def by_length(audio: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in audio of recordings of one length, a few at a time, and the responses of each. Null recordings are as empty ones."""
    pcm = [a.as_py() or b"" for a in audio]
    sizes = np.array([len(a) // 2 for a in pcm], np.int64)
    for size in np.unique(sizes):
        at, step = np.flatnonzero(sizes == size), max(1, SAMPLES // max(int(size), 1))
        for begin in range(0, len(at), step):
            of = at[begin : begin + step]
            yield of, responses(chromas(np.stack([np.frombuffer(pcm[i], dtype="<i2", count=size) for i in of])))


def sampled(table: DataFrame, key: str, most_rows: int = 256) -> DataFrame:
    """At most most_rows rows of table, those of smallest hash of key; rows with a null key are left out."""
    return table.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(most_rows)


#: Steps in a unit of a filter's response, in which the quartiles are counted. Responses are within log(1 + WIDEST) of 0.
STEPS = 1 << 12


def fit_levels(media: DataFrame, most_rows: int | None = None) -> np.ndarray:
    """Quartiles of each filter's responses over all recordings, or over most_rows of them, those of smallest hash of id.

    Responses are counted by steps of 1 / STEPS; a level is the least step at or below which there is the quarter's share of all. A task
    passes on one count a filter and step, so neither the rows nor their responses meet anywhere."""
    heard = media.filter("audio is not null")
    rows = heard if most_rows is None else sampled(heard, "id", most_rows)
    least = -int(np.ceil(STEPS * np.log(1 + WIDEST))) - 1  # rounding may leave a sum a hair above its bound
    width = 1 - 2 * least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(FILTERS) * width, np.int64)
        for batch in batches:
            found = [np.ceil(values * STEPS).astype(np.int32).reshape(-1, len(FILTERS)) for _, values in by_length(batch.column("audio"))]
            if found:
                counts += np.bincount((np.concatenate(found) - least + width * np.arange(len(FILTERS))).ravel(), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width + least).astype(np.int32)), pa.array(counts[at])], names=["filter", "step", "n"])

    counted = rows.select("audio").mapInArrow(run, "filter int, step int, n long").groupBy("filter", "step").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("filter")
    through, total = F.sum("n").over(own.orderBy("step")), F.sum("n").over(own)  # at most `width` rows a filter
    summed = counted.select("filter", "step", through.alias("through"), total.alias("total"))
    cuts = summed.groupBy("filter").agg(*(F.min(F.when(4 * F.col("through") >= k * F.col("total"), F.col("step"))).alias(f"cut_{k}") for k in (1, 2, 3)))
    levels = np.zeros((len(FILTERS), 3))
    for r in cuts.collect():  # a row a filter
        levels[r["filter"]] = r["cut_1"] / STEPS, r["cut_2"] / STEPS, r["cut_3"] / STEPS
    return levels


def fingerprints(media: DataFrame, levels: np.ndarray) -> DataFrame:
    """id, words (array of 32-bit integers as long), digest of the words.

    Null, empty and short recordings have no words. Rows with a null id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.empty(0, np.uint32)] * batch.num_rows
            for places, values in by_length(batch.column("audio")):
                for i, own in zip(places, pack(values, levels), strict=True):
                    words[i] = own
            columns = [batch.column("id"), pa.array([w.astype(np.int64) for w in words], pa.list_(pa.int64())), pa.array([hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "words", "digest"])

    return media.filter("id is not null").select("id", "audio").mapInArrow(run, "id long, words array<long>, digest binary")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits of a[i] and b[i + offset], and how many words overlap."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    x = (a[lo:hi] ^ b[lo + offset : hi + offset]).astype(np.uint32)
    return float(np.bitwise_count(x).sum()) / (32 * (hi - lo)), hi - lo


#: Words in a block of recordings and in a block of queries, in the mean, and of the queries that are looked up at once.
BLOCK_WORDS, QUERY_WORDS, ASKED_WORDS = 300_000, 160_000, 40_000
#: Votes that are looked at at once, and words that are compared at once.
VOTES, TOGETHER = 1 << 15, 1_000_000
#: Consecutive words whose bits are compared as one row.
RUN = 8
#: The pairs of a word's four bytes.
BYTE_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


class Words:
    """Recordings' words end to end."""

    def __init__(self, recordings: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in recordings], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.count = int(self.sizes.sum())
        self.words = np.concatenate([*recordings, np.zeros(2 * RUN, np.uint32)]).astype(np.uint32)
        self.owner = np.repeat(np.arange(len(recordings), dtype=np.int32), self.sizes)
        self.start = (np.arange(self.count) - np.repeat(self.begins, self.sizes)).astype(np.int32)  # place in its recording
        self.left = (np.repeat(self.sizes, self.sizes) - self.start).astype(np.int32)  # words from here to its recording's end
        self.runs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.words, RUN)).view(np.uint64)

    def keys(self) -> np.ndarray:
        """A row for each pair of bytes, a column for each word."""
        part = self.words[: self.count].view(np.uint8).reshape(-1, 4).astype(np.uint16)
        return np.stack([part[:, i] << np.uint16(8) | part[:, j] for i, j in BYTE_PAIRS])


class Block(Words):
    """Recordings whose words are found by any two of their four bytes."""

    def __init__(self, recordings: list[np.ndarray]):
        super().__init__(recordings)
        keys = self.keys()
        order = np.concatenate([np.argsort(k, kind="stable") for k in keys])
        self.lists, self.list_start, self.list_left = order.astype(np.int32), self.start[order], self.left[order]
        self.held = np.concatenate([np.bincount(k, minlength=65_536) for k in keys])
        self.ends = self.held.cumsum()

    def _votes(self, sizes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Parts of the looked up lists: which of them, their sizes, and the places of all their words in self.lists."""
        through = sizes.cumsum()
        edges = np.unique(np.append(np.searchsorted(through, np.arange(0, through[-1], VOTES)), len(sizes))) if len(sizes) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            n = sizes[a:b]
            yield slice(a, b), n, np.repeat(begin[a:b] - n.cumsum() + n, n) + np.arange(n.sum())

    def _near(self, asked: Words, mine: np.ndarray, there: np.ndarray, overlap: np.ndarray, most_error: float, least_overlap: int) -> tuple[np.ndarray, ...]:
        """Those overlaps, by their first word in `asked` and here, that are long enough and whose runs from the first on do not differ
        in more bits than the whole overlap may. None that is near enough is left out; `_measured` says which are."""
        limit, out = 32 * most_error * (1 + 1e-9), []
        mine, there = mine.astype(np.intp), there.astype(np.intp)
        if least_overlap < RUN:
            short = overlap < RUN
            out.append([np.compress(short & (overlap >= least_overlap), x) for x in (mine, there, overlap)])
            mine, there, overlap = (np.compress(~short, x) for x in (mine, there, overlap))
        differ, done = np.zeros(len(mine), np.int32), 0
        while len(mine):
            bits = np.bitwise_count(self.runs.take(there + done, axis=0) ^ asked.runs.take(mine + done, axis=0)).view(np.uint32).ravel()
            differ += (bits * np.uint32(0x01010101) >> np.uint32(24)).astype(np.int32)  # the sum of four bytes, which is 0 rather than 256 if all bits differ
            done += RUN
            near, last = differ <= limit * overlap, overlap < done + RUN
            at = np.flatnonzero(last & near & (overlap >= least_overlap))
            out.append([x.take(at) for x in (mine, there, overlap)])
            at = np.flatnonzero(near & ~last if done > RUN else ~last)  # one run says little about a longer overlap
            mine, there, overlap, differ = (x.take(at) for x in (mine, there, overlap, differ))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (mine, there, overlap)

    def _measured(self, asked: Words, mine: np.ndarray, there: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits differ in each overlap, and its votes: how many pairs of bytes agree."""
        differ, votes = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        part = (overlap.cumsum() - overlap) // TOGETHER
        for a, b in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
            n = overlap[a:b]
            first = n.cumsum() - n
            x = asked.words.take(np.repeat(mine[a:b] - first, n) + np.arange(n.sum())) ^ self.words.take(np.repeat(there[a:b] - first, n) + np.arange(n.sum()))
            same = (x.view(np.uint8).reshape(-1, 4) == 0).sum(axis=1)
            differ[a:b] = np.add.reduceat(np.bitwise_count(x), first, dtype=np.int64)
            votes[a:b] = np.add.reduceat(same * (same - 1) // 2, first)
        return differ, votes

    def links(self, queries: list[np.ndarray], most_error: float, least_overlap: int) -> tuple[np.ndarray, ...]:
        """query, recording, offset, bit error, overlap: for each query and recording the offset of most votes (the smallest such) that is near enough."""
        asked = Words(queries)
        key = (asked.keys() + 65_536 * np.arange(len(BYTE_PAIRS))[:, None]).T.ravel()
        sizes, begin = self.held[key], self.ends[key] - self.held[key]
        through = np.append(0, sizes.cumsum())
        votes = through[len(BYTE_PAIRS) * (asked.begins + asked.sizes)] - through[len(BYTE_PAIRS) * asked.begins]
        many = 8 * votes > self.count + len(self.sizes) * asked.sizes  # so many that offsets may have several each
        found = []
        few = np.flatnonzero(np.repeat(~many, len(BYTE_PAIRS) * asked.sizes))
        few = few[np.argsort(key[few], kind="stable")]  # a list is looked up again while its words are still at hand
        word = (few // len(BYTE_PAIRS)).astype(np.int32)
        start, left = asked.start[word], asked.left[word]
        for of, n, at in self._votes(sizes[few], begin[few]):
            back = np.minimum(np.repeat(start[of], n), self.list_start.take(at))
            overlap = back + np.minimum(np.repeat(left[of], n), self.list_left.take(at))
            found.append(self._near(asked, np.repeat(word[of], n) - back, self.lists.take(at) - back, overlap, most_error, least_overlap))
        for q in np.flatnonzero(many):
            found += self._near_by_offset(asked, q, sizes, begin, most_error, least_overlap)
        mine, there, overlap = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        once = np.unique(mine * max(self.count, 1) + there, return_index=True)[1]
        mine, there, overlap = mine[once], there[once], overlap[once].astype(np.int64)
        differ, votes = self._measured(asked, mine, there, overlap)
        error = differ / (32 * np.maximum(overlap, 1))
        query, recording = asked.owner[mine], self.owner[there]
        offset = self.start[there].astype(np.int64) - asked.start[mine]
        good = error <= most_error
        query, recording, offset, votes, error, overlap = (x[good] for x in (query, recording, offset, votes, error, overlap))
        order = np.lexsort((offset, -votes, recording, query))
        first = order[np.unique((query.astype(np.int64) * max(len(self.sizes), 1) + recording)[order], return_index=True)[1]]
        return query[first], recording[first], offset[first], error[first], overlap[first]

    def _near_by_offset(self, asked: Words, q: int, sizes: np.ndarray, begin: np.ndarray, most_error: float, least_overlap: int) -> list[tuple[np.ndarray, ...]]:
        """_near for a query of common words: each offset is looked at once, however many votes it has."""
        n = int(asked.sizes[q])
        base = np.cumsum(self.sizes + n) - (self.sizes + n) + n - 1  # the slot of offset 0
        voted = np.zeros(int((self.sizes + n).sum()), bool)
        own = slice(len(BYTE_PAIRS) * asked.begins[q], len(BYTE_PAIRS) * (asked.begins[q] + n))
        place = np.arange(len(BYTE_PAIRS) * n) // len(BYTE_PAIRS)
        for of, each, at in self._votes(sizes[own], begin[own]):
            voted[self.list_start.take(at) + base[self.owner.take(self.lists.take(at))] - np.repeat(place[of], each)] = True
        slots, out = np.flatnonzero(voted), []
        for a in range(0, len(slots), VOTES):
            slot = slots[a : a + VOTES]
            recording = np.searchsorted(base + self.sizes, slot, side="right")
            offset = slot - base[recording]
            low = np.maximum(0, -offset)
            overlap = np.minimum(n, self.sizes[recording] - offset) - low
            out.append(self._near(asked, asked.begins[q] + low, self.begins[recording] + offset + low, overlap, most_error, least_overlap))
        return out

    def matches(self, query: np.ndarray, most_error: float, least_overlap: int) -> tuple[np.ndarray, ...]:
        """recording, offset, bit error, overlap: the links of one query."""
        return self.links([query], most_error, least_overlap)[1:]


def align(marks: DataFrame, query_divisor: int = 50, most_error: float = 0.2, least_overlap: int = 8) -> DataFrame:
    """query_id, match_id, class_size, offset, bit_error, overlap: recordings that match each query.

    marks: id, words, digest. Queries: ids divisible by query_divisor. Recordings of equal words are one
    class, named by its smallest id and met once, so a third of all rows may be copies; a query's own
    class is given too if it has other members. Every block of recordings meets every block of queries; in a task
    the words that agree in two of their four bytes vote for an offset, and every offset with a vote is compared bit by bit, in runs of words from the
    first on until more bits differ than its whole overlap may. So this takes time with queries times recordings, but little for each pair. Of 36 overlapping
    words with a fifth of their bits changed, all lack a vote with a probability below 0.01; of 8 such words 0.32, with a tenth changed
    below 0.003. Recordings of fewer than least_overlap words match nothing, as no overlap can be long
    enough. Rows that repeat an id are recordings like others: their id comes once for each."""
    some = marks.filter(F.size("words") >= least_overlap)
    classes = some.groupBy("digest").agg(F.min(F.struct("id", "words")).alias("r"), F.count("*").alias("class_size"))
    classes = stored(classes.select("digest", F.col("r.id").alias("match_id"), "class_size", F.col("r.words").alias("words")), "classes")
    asked = stored(some.filter(F.col("id") % query_divisor == 0).select(F.col("id").alias("query_id"), F.col("digest").alias("query_class")), "asked")
    queries = classes.join(asked.select(F.col("query_class").alias("digest")).distinct(), "digest", "left_semi")
    words = lambda rows: rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks, sets = (max(1, -(-n // size)) for n, size in ((words(classes), BLOCK_WORDS), (words(queries), QUERY_WORDS)))
    deal = lambda parts: F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = classes.select("digest", "words", deal(blocks).alias("block"), every(sets).alias("set"))
    right = queries.select("digest", "words", deal(sets).alias("set")).toDF("query_digest", "query_words", "query_set").withColumn("query_block", every(blocks))

    def run(held: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("query_class", "digest", "offset", "bit_error", "overlap")})]
        block, queries = Block([np.asarray(x, np.uint32) for x in held["words"]]), [np.asarray(x, np.uint32) for x in given["query_words"]]
        part = np.cumsum([len(x) for x in queries]) // ASKED_WORDS
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            query, recording, offset, error, overlap = block.links([queries[i] for i in at], most_error, least_overlap)
            out.append(pd.DataFrame({"query_class": given["query_digest"].to_numpy()[at[query]], "digest": held["digest"].to_numpy()[recording], "offset": offset, "bit_error": error, "overlap": overlap}))
        return pd.concat(out[1:] or out)

    grouped = left.groupBy("block", "set").cogroup(right.groupBy("query_block", "query_set"))
    good = grouped.applyInPandas(run, "query_class binary, digest binary, offset int, bit_error double, overlap int")
    sized = asked.join(good, "query_class").join(classes.select("digest", "match_id", "class_size"), "digest")
    other = (F.col("digest") != F.col("query_class")) | (F.col("class_size") > 1)
    return sized.filter(other).select("query_id", "match_id", "class_size", "offset", "bit_error", "overlap")


#: Links in a row of by_query, about as many at most.
LINKS = 4096


def by_query(links: DataFrame) -> DataFrame:
    """query_id, part, n_links, links: every row of `align`, as one row a query; n_links counts the query's links.

    links: a stored table, which is read twice. A query of more than LINKS links has them dealt to parts by hash of match_id, so no
    query's links need to fit one row or one task."""
    sizes = links.groupBy("query_id").agg(F.count("*").alias("n_links"))
    part = F.pmod(F.xxhash64("match_id"), F.ceil(F.col("n_links") / LINKS)).cast("int")
    row = F.struct("match_id", "class_size", "offset", "bit_error", "overlap")
    dealt = links.join(sizes, "query_id").withColumn("part", part)
    return dealt.groupBy("query_id", "part", "n_links").agg(F.array_sort(F.collect_list(row)).alias("links"))


def rendered(vectors: DataFrame, seconds: float = 3.0, notes: int = 16, takes: int = 2) -> DataFrame:
    """id, audio: a stand-in media column, `takes` recordings of each vector. Take t of vec_id v has id takes * v + t.

    A vector is cut into `notes` parts. A part's components, dealt to four sums, set a chord's three tones and its
    loudness, so the sound is a function of all components: near vectors sound alike, others do not. A take has its own
    noise, loudness and silence before it. Null vectors and ids, and vectors with a null or non-finite
    component, have null audio."""
    size = int(seconds * RATE / notes)
    tones = np.sin(2 * np.pi * (220.0 * 2 ** (np.arange(24) / 12))[:, None] * (np.arange(size) / RATE))

    def tune(x: np.ndarray) -> np.ndarray | None:
        if not len(x) or not np.isfinite(x).all():
            return None
        part = np.arange(len(x)) * notes // len(x)
        nth = np.arange(len(x)) - np.searchsorted(part, part)
        sums = np.zeros((notes, 4))
        np.add.at(sums, (part, nth % 4), x * np.sqrt(len(x)))
        level = 0.5 + 0.5 * np.tanh(sums)
        chords = np.minimum((24 * level[:, :3]).astype(int), 23)
        return (tones[chords].sum(axis=1) * (0.7 + 0.6 * level[:, 3:])).ravel()

    def take(sound: np.ndarray | None, i: int | None) -> bytes | None:
        if i is None or sound is None:
            return None
        rng = np.random.default_rng([7, abs(i)])
        pcm = rng.normal(scale=0.05, size=sound.size)
        pcm += sound
        pcm *= rng.uniform(4000, 8000)
        return b"\0\0" * (i % takes * HOP) + np.clip(pcm, -32768, 32767, out=pcm).astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                column = part.column("embedding")
                values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
                sizes = np.array(pc.list_value_length(column).fill_null(0), np.int64)
                ends = sizes.cumsum()
                sounds = [tune(values[end - size : end]) for size, end in zip(sizes, ends, strict=True)]
                ids = [None if i is None else takes * i for i in part.column("vec_id").to_pylist()]
                for t in range(takes):
                    own = [None if i is None else i + t for i in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([take(s, i) for s, i in zip(sounds, own, strict=True)], pa.binary())], names=["id", "audio"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "id long, audio binary")
