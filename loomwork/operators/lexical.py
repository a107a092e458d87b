"""BM25 over an index of segments, and an index of files that is kept and refreshed file by file.

A segment is the inverted index of some thousand documents, made by one task in one pass over their texts:
a row for each term with its documents and counts, and one row of the documents with their lengths. No posting is
shuffled to build it. Weights depend on the whole corpus, so they are worked out when a query is asked.

A search brings the asked terms' rows of a segment to one task. In a segment of up to WHOLE documents all weights are summed. In one
of more, of short texts, each term's postings stand in blocks by falling
weight, each block with its greatest weight. Blocks are read by what they can add at most; reading stops when
all unread blocks together stay below the k-th score so far, and few documents can still pass it. Those
few get their whole scores by binary search in the terms' documents; the blocks left are skipped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.text import tokenize, tokens_of
from loomwork.sources.shared import shared_dir, small, stored, text_batches

# Fixed values of the score.
K1, B = 1.5, 0.75
#: Postings in a segment before it is closed, postings in a block, queries that meet a segment at once.
SEGMENT, BLOCK, TOGETHER = 1 << 19, 128, 1024
#: Bytes a task of files that are few and small enough to be dealt out anew.
SMALL_FILE = 1 << 25
#: Documents that get whole scores when the rest is ruled out.
FEW = 2048
#: Documents of a segment whose scores are summed whole, as reading blocks one by one takes longer.
WHOLE = 8192
NO_ID = np.iinfo(np.int64).min

SEGMENTS = "file string, segment string, term string, n long, tokens long, docs binary, counts binary"


#: A byte as a token has it (letters in lower case), or 0 where no token goes on; and bytes that CJK characters can begin with.
_BYTES = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _BYTES[_c] = _BYTES[ord(chr(_c).upper())] = _c
_CJK_BYTES = np.isin(np.arange(256), [*range(0xE3, 0xEA), 0xEF])


def batch_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts, as tokens_of gives them, and each one's text by place; null texts have none.

    Runs of letters and digits are cut out of the texts' bytes together; only texts with characters that may be CJK are read one by one."""
    texts = texts.cast(pa.string()).fill_null("")
    n, (_, ends, data) = len(texts), texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    at = np.flatnonzero(_CJK_BYTES[data])
    apart = np.unique(np.searchsorted(ends, at, side="right") - 1)
    plain = _BYTES[data]
    for i in apart:
        plain[ends[i] : ends[i + 1]] = 0
    inside = plain != 0
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]  # no token goes across texts
    new[first] = inside[first]
    kept, begins = plain[inside], np.flatnonzero(new[inside])
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(kept)).astype(np.int32)), pa.py_buffer(kept))
    owner = np.searchsorted(ends, np.flatnonzero(new), side="right") - 1
    if len(apart):
        more = [tokens_of(texts[int(i)].as_py()) for i in apart]
        found = pa.concat_arrays([found, pa.array([t for x in more for t in x], pa.string())])
        owner = np.concatenate([owner, np.repeat(apart, [len(x) for x in more])])
    return found, owner


class _Counted:
    """The texts of a batch: for each its tokens, and its terms (by number, ascending) with their counts."""

    def __init__(self, texts: pa.Array):
        found, owner = batch_tokens(texts)
        found = found.dictionary_encode()
        self.terms, n = found.dictionary, len(texts)
        self.lengths = np.bincount(owner, minlength=n).astype(np.int32)
        keys = np.sort(owner.astype(np.int64) * max(1, len(self.terms)) + found.indices.to_numpy())
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.docs, self.codes = np.divmod(keys[first], max(1, len(self.terms)))
        self.counts = np.diff(np.append(first, len(keys))).astype(np.int32)
        self.ends = np.append(0, np.bincount(self.docs, minlength=n).cumsum())  # of each text's terms


class _Segment:
    """Documents of one file until there are SEGMENT postings."""

    def __init__(self, file: str, name: str):
        self.file, self.name = file, name
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.terms: list[pa.Array] = []  # of each part, those that its documents hold
        self.codes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = self.size = self.n_terms = 0

    def add(self, ids: np.ndarray, batch: _Counted, begin: int, end: int) -> None:
        """The batch's texts from begin to end."""
        own = slice(batch.ends[begin], batch.ends[end])
        codes = batch.codes[own]
        held = np.zeros(len(batch.terms), bool)
        held[codes] = True
        self.terms.append(batch.terms.take(pa.array(np.flatnonzero(held))))
        self.codes.append(held.cumsum()[codes] - 1 + self.n_terms)
        self.docs.append(batch.docs[own] - begin + self.n)
        self.counts.append(batch.counts[own])
        self.ids.append(ids[begin:end])
        self.lengths.append(batch.lengths[begin:end])
        self.n, self.size, self.n_terms = self.n + end - begin, self.size + len(codes), self.n_terms + len(self.terms[-1])

    def rows(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(self.n, np.int64)
        place[by_id] = np.arange(self.n)  # documents are numbered in the order of their ids
        terms = pa.concat_arrays(self.terms).dictionary_encode()
        order = pc.array_sort_indices(terms.dictionary)  # by bytes, which is by characters
        names = terms.dictionary.take(order)
        by_name = np.empty(len(names), np.int64)
        by_name[order.to_numpy()] = np.arange(len(names))
        codes, docs = by_name[terms.indices.to_numpy()[np.concatenate(self.codes)]], place[np.concatenate(self.docs)]
        order = np.argsort(codes * self.n + docs)
        many = np.bincount(codes, minlength=len(names))
        lengths = np.concatenate(self.lengths)[by_id]

        def values(head: np.ndarray, of: np.ndarray) -> pa.Array:
            """The documents' bytes, then each term's."""
            ends = len(head.tobytes()) + 4 * np.cumsum(many)
            return pa.Array.from_buffers(pa.binary(), len(names) + 1, [None, pa.py_buffer(np.concatenate([[0, len(head.tobytes())], ends]).astype(np.int32)), pa.py_buffer(head.tobytes() + of[order].tobytes())])

        n = len(names) + 1
        columns = [
            pa.repeat(pa.scalar(self.file, pa.string()), n), pa.repeat(pa.scalar(self.name, pa.string()), n), pa.concat_arrays([pa.nulls(1, pa.string()), names]), pa.array(np.concatenate([[self.n], many]).astype(np.int64)),
            pa.array([int(lengths.sum()), *[None] * len(names)], pa.int64()), values(ids[by_id], docs.astype(np.int32)), values(lengths, np.concatenate(self.counts)),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEGMENTS.split(", ")])


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """The rows of SEGMENTS of the documents; `file` is a column that no segment goes across.

    The row without a term has a segment's documents: n, all tokens, ids, lengths; the others a term's documents, as places
    in the former, and counts. Ids are whole numbers. A document without text or tokens counts as one; one with a null id counts
    in the statistics but is never found. Rows that share an id are documents of their own."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"ids are whole numbers, not {docs.schema[key].dataType.simpleString()}")
    run = uuid.uuid4().hex

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            counted, files = _Counted(batch.column(2)), batch.column(0).to_pylist()
            ids = batch.column(1).fill_null(NO_ID).to_numpy()
            last = np.append(np.flatnonzero([a != b for a, b in pairwise(files)]) + 1, len(files))  # where a file's rows end
            begin = 0
            while begin < len(files):
                if held is not None and (held.size >= SEGMENT or held.file != files[begin]):
                    yield held.rows()
                    held = None
                if held is None:
                    held, made = _Segment(files[begin], f"{run}-{part}-{made}"), made + 1
                full = int(np.searchsorted(counted.ends, counted.ends[begin] + SEGMENT - held.size))  # with the text that fills it
                end = min(full, int(last[np.searchsorted(last, begin, side="right")]))
                held.add(ids, counted, begin, end)
                begin = end
        if held is not None:
            yield held.rows()

    of = F.lit("") if file is None else F.col(file)
    return docs.select(of.alias("_file"), F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(build, SEGMENTS)


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n_docs (texts without tokens included), n_terms, n_tokens, avgdl (0 for no text)."""
    totals = index.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
    kinds = index.filter("term is not null").groupBy("term").count().agg(F.count("*").alias("n_terms"))
    return totals.join(F.broadcast(kinds)).select("n_docs", "n_terms", "n_tokens", F.coalesce(F.try_divide("n_tokens", "n_docs"), F.lit(0.0)).alias("avgdl"))  # one row each


class Postings:
    """The asked terms of one segment, ready to be searched."""

    def __init__(self, lengths: np.ndarray, docs: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, avgdl: float):
        self.n, self.docs, self.weights, self.order, self.tops = len(lengths), docs, [], [], []
        self.read = self.blocks = 0
        scaled = K1 * (1 - B + B * lengths / avgdl)
        for d, c, w in zip(docs, counts, idf, strict=True):
            weight = w * c * (K1 + 1) / (c + scaled[d])
            self.weights.append(weight)
            if self.n > WHOLE:
                order = np.argsort(-weight, kind="stable")
                self.order.append(order)
                self.tops.append(weight[order[::BLOCK]])  # each block's greatest weight

    def _summed(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """As best, from all postings; in one order for all documents, so that equal ones have equal scores."""
        score = np.zeros(self.n)
        for t in terms:
            score[self.docs[t]] += self.weights[t]  # a term has a document once, and weights are above 0
        found = np.flatnonzero(score)
        if len(found) > k:  # with all that are level with the k-th in nine digits
            kth = np.partition(score[found], len(found) - k)[len(found) - k]
            found = found[score[found] >= kth - 1e-8]
        chosen = np.lexsort((found, -np.round(score[found], 9)))[:k]
        return found[chosen], score[found[chosen]]

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by place) and whole scores of the k best, ties by place."""
        if self.n <= WHOLE:
            return self._summed(terms, k)
        score, seen = np.zeros(self.n), np.zeros(self.n, dtype=bool)
        term = np.concatenate([np.full(len(self.tops[t]), i) for i, t in enumerate(terms)])
        block = np.concatenate([np.arange(len(self.tops[t])) for t in terms])
        top = np.concatenate([self.tops[t] for t in terms])
        queue = np.argsort(-top, kind="stable")  # a term's blocks keep their order
        rest = np.array([self.tops[t][0] for t in terms])
        at, step = 0, max(8, len(queue) // 16)
        alive = None
        while at < len(queue):
            for j in queue[at : at + step]:
                t = terms[term[j]]
                chosen = self.order[t][block[j] * BLOCK : (block[j] + 1) * BLOCK]
                docs = self.docs[t][chosen]
                score[docs] += self.weights[t][chosen]
                seen[docs] = True
                after = block[j] + 1
                rest[term[j]] = self.tops[t][after] if after < len(self.tops[t]) else 0.0
            at += step
            if at < len(queue) and self.n > k:
                floor = np.partition(score, self.n - k)[self.n - k] - 1e-8
                if rest.sum() < floor:  # a document met nowhere stays below
                    alive = np.flatnonzero(score + rest.sum() >= floor)
                    if len(alive) <= max(FEW, 4 * k):
                        break
                    alive = None
        self.read, self.blocks = self.read + min(at, len(queue)), self.blocks + len(queue)
        if alive is None:
            alive = np.flatnonzero(seen)
        whole = np.zeros(len(alive))
        for t in terms:  # in one order for all documents, so that equal ones have equal scores
            place = np.minimum(np.searchsorted(self.docs[t], alive), len(self.docs[t]) - 1)
            whole += np.where(self.docs[t][place] == alive, self.weights[t][place], 0.0)
        chosen = np.lexsort((alive, -np.round(whole, 9)))[:k]
        return alive[chosen], whole[chosen]


def ranked_terms(index: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query_id, id, score, rank of the texts that hold a term of the query; index: rows of `segments`, a stored table.

    queries: query_id, query, any number of them. Jobs run while this is built: the corpus's totals, counts of the asked terms, and the writing
    of the index's rows of these to the shared folder.
    A segment's terms meet at most TOGETHER queries in a task."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    n, tokens = index.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    sets = max(1, -(-queries.count() // TOGETHER))
    asked = queries.select("query_id", F.pmod(F.xxhash64("query_id"), F.lit(sets)).alias("set"), F.explode(F.array_distinct(tokenize("query"))).alias("term"))
    by_term = small(asked.groupBy("term", "set").agg(F.collect_list("query_id").alias("queries")))
    met = index.filter("term is not null").join(small(asked.select("term").distinct()), "term", "left_semi")
    met = stored(met.select("segment", "term", "n", "docs", "counts"), "met")  # the index's terms are read once
    df = met.groupBy("term").agg(F.sum("n").alias("df"))
    found = met.join(by_term, "term").join(small(df), "term").select("segment", "set", "term", "docs", "counts", "df", "queries")
    none = F.lit(None)
    heads = index.filter("term is null").select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))).alias("set"), none.cast("string").alias("term"), "docs", "counts", none.cast("long").alias("df"), none.cast(found.schema["queries"].dataType).alias("queries"))
    avgdl, wanted = (tokens / n if n else 0.0), max(most, 0)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        head, part = part[part["term"].isna()], part[part["term"].notna()].sort_values("term")
        out = []
        if len(part) and wanted:
            ids, lengths = np.frombuffer(head["docs"].iloc[0], np.int64), np.frombuffer(head["counts"].iloc[0], np.int32)
            numbers = part["df"].to_numpy(np.float64)
            idf = np.log(1 + (n - numbers + 0.5) / (numbers + 0.5))
            arrays = lambda c, kind: [np.frombuffer(x, kind) for x in part[c]]
            postings = Postings(lengths, arrays("docs", np.int32), arrays("counts", np.int32), idf, avgdl)
            terms: dict = {}
            for i, asking in enumerate(part["queries"]):
                for q in asking:
                    terms.setdefault(q, []).append(i)
            more = int((ids == NO_ID).sum())
            for q, held in terms.items():
                docs, score = postings.best(held, wanted + more)
                there = ids[docs] != NO_ID
                out.append((q, ids[docs][there], score[there]))
        if not out:
            return pd.DataFrame({"query_id": [], "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        asking, found, score = zip(*out, strict=True)
        names = pd.Series(asking).repeat([len(x) for x in found]).reset_index(drop=True)
        return pd.DataFrame({"query_id": names, "id": np.concatenate(found), "score": np.concatenate(score)})

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    scores = found.unionByName(heads).groupBy("segment", "set").applyInPandas(run, schema)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, length, stamp (size and time of change) of each file; no content is read."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(F.col("path").alias("file"), "length", F.concat_ws(" ", "length", F.unix_micros("modificationTime")).alias("stamp"))


class FileIndex:
    """The index of the Parquet files at `path`, kept in a folder and read again only where files have changed.

    Each refresh writes the segments of new and changed files as one run, and a list of the files there are
    with their size, time of change and run. Files that are gone, and what earlier runs hold of changed ones, are
    not read any more. One driver refreshes an index at a time. Without a folder it is kept in the shared one, until the driver ends."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", folder: str | None = None):
        self.spark, self.path, self.key, self.text = spark, path, key, text
        mark = hashlib.sha1(f"{path} {key} {text}".encode()).hexdigest()
        self.folder = folder or f"{shared_dir(spark)}/loomwork-terms-{mark}"
        self.scanned: list[str] = []  # files that the last refresh read

    def _listed(self) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []

    def refresh(self) -> DataFrame:
        """The index's rows as of now."""
        there = self._listed()
        lists = [x for x in there if x.startswith("files-") and f"{self.folder}/{x}"]
        now = _files(self.spark, self.path)
        kept = "file string, stamp string, run string"
        before = self.spark.read.schema(kept).parquet(f"{self.folder}/{lists[-1]}") if lists else self.spark.range(0).selectExpr("'' AS file", "'' AS stamp", "'' AS run")
        state = now.join(before, ["file", "stamp"], "left")
        changed = state.filter("run is null").select("file", "length").collect()  # names of files, not rows of them
        self.scanned = [r["file"] for r in changed]
        gone = before.join(now, ["file", "stamp"], "left_anti").limit(1).count()
        if self.scanned or gone or not lists:
            run = f"run-{len(lists):06d}-{uuid.uuid4().hex}"
            if self.scanned:
                docs = self.spark.read.parquet(*self.scanned).select(self.key, self.text, F.col("_metadata.file_path").alias("_from"))
                tasks = self.spark.sparkContext.defaultParallelism
                if len(changed) < tasks and sum(r["length"] for r in changed) < tasks * SMALL_FILE:  # a small file is often one task's
                    docs = docs.repartition(tasks)
                with text_batches(self.spark):
                    segments(docs, self.key, self.text, "_from").write.parquet(f"{self.folder}/{run}")
            name = f"files-{len(lists):06d}"
            state.select("file", "stamp", F.coalesce("run", F.lit(run)).alias("run")).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            before = self.spark.read.schema(kept).parquet(f"{self.folder}/{name}")
        runs = [r["run"] for r in before.select("run").distinct().collect()]
        out = None
        for run in runs:
            rows = self.spark.read.schema(SEGMENTS).parquet(f"{self.folder}/{run}")
            live = before.filter(F.col("run") == run).select("file")
            rows = rows if len(runs) == 1 and not gone else rows.join(small(live), "file", "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], SEGMENTS)


def index_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of any documents, written once to the shared folder."""
    with text_batches(docs.sparkSession):
        return stored(segments(docs, key, text), "segments")
