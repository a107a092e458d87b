"""URL rules in a sorted digest array: memory-mapped 64-bit keys, vectorised binary search, confirmed strings.

A rule is a host and a path. It fits its host and all subdomains, if the url's path starts with the
rule's; the longest fitting rule wins (host and path together, then the longer host). Each url gives
one key for each of its host's suffixes and each path length that rules have; keys are looked up
in the sorted array, and a hit counts only if the stored string is the same.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules of a list that is sent to every executor: about 100 bytes each, so 500 MB at most.
MOST_RULES = 5_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end.

    Both are empty for a null url and one without ://."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


@dataclass
class DigestArray:
    """Names of the files that the session has sent to its executors, the rules' path lengths, and the most labels of a rule's host."""

    files: dict[str, str]
    lengths: list[int]
    labels: int

    def open(self) -> OpenArray:
        at = {k: SparkFiles.get(v) for k, v in self.files.items()}
        return OpenArray(np.memmap(at["keys"], dtype=np.uint64, mode="r"), np.memmap(at["ends"], dtype=np.int64, mode="r"), np.memmap(at["text"], dtype=np.uint8, mode="r"), np.memmap(at["allow"], dtype=bool, mode="r"))


@dataclass
class OpenArray:
    keys: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    allow: np.ndarray

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Number of each candidate's rule, -1 if there is none. Rules of equal digests lie side by side."""
        digests = np.array([xxhash.xxh64_intdigest(x) for x in candidates], dtype=np.uint64)
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(candidates), -1, dtype=np.int64)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for i in hit:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out


def _key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode()


def build(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DigestArray:
    """A digest array of (host, path, block or allow), sent to the executors as files.

    The first of two rules with the same host and path counts. More than MOST_RULES are refused."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a digest array that every executor holds takes {MOST_RULES}")
    verdicts: dict[bytes, bool] = {}
    for host, path, verdict in rules:
        verdicts.setdefault(_key(host.translate(str.maketrans(_UPPER, _UPPER.lower())), path), verdict == "allow")
    strings = sorted(verdicts, key=lambda x: (xxhash.xxh64_intdigest(x), x))
    parts = {
        "keys": np.array([xxhash.xxh64_intdigest(x) for x in strings], dtype=np.uint64),
        "ends": np.append(0, np.cumsum([len(x) for x in strings])).astype(np.int64),
        "text": np.frombuffer(b"".join(strings), dtype=np.uint8),
        "allow": np.array([verdicts[x] for x in strings], dtype=bool),
    }
    folder, files = tempfile.mkdtemp(prefix="loomwork-"), {}
    tag = os.path.basename(folder)
    for name, data in parts.items():
        files[name] = f"{tag}-{name}"
        data.tofile(f"{folder}/{files[name]}")
        spark.sparkContext.addFile(f"{folder}/{files[name]}")
    return DigestArray(files, sorted({len(x.split(b"\0", 1)[1].decode()) for x in strings}), max((x.split(b"\0", 1)[0].count(b".") + 1 for x in strings), default=0))


def judged(pages: DataFrame, array: DigestArray, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages, repeated rows and null ids included.

    Of a host only as many labels are looked up as the longest rule has, so a very long one costs no more. Without a fitting rule, rule is null and the verdict is `otherwise`: a url that no list holds passes.
    Extra columns are ignored; an empty table gives no rows."""
    host, path = host_and_path(F.col("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = array.open() if array.lengths else None
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            row, size, keys = [], [], []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                labels = h.rsplit(".", array.labels)[-array.labels :]  # no rule fits a longer suffix
                for n in range(len(labels)):
                    suffix = ".".join(labels[n:])
                    for length in array.lengths:
                        if length <= len(p):
                            row.append(i)
                            size.append((len(suffix) + length, len(suffix)))
                            keys.append(_key(suffix, p[:length]))
            found = rules.find(keys) if keys else []
            best: dict[int, tuple] = {}
            for i, s, k, j in zip(row, size, keys, found, strict=True):
                if j >= 0 and s > best.get(i, ((-1, -1),))[0]:
                    best[i] = (s, k.decode().replace("\0", "", 1), "allow" if rules.allow[j] else "block")
            n = range(len(hosts))
            rule = pa.array([best[i][1] if i in best else None for i in n], pa.string())
            verdict = pa.array([best[i][2] if i in best else otherwise for i in n], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
