"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

The pieces, their log scores and kinds are read from a model file, whose path is a parameter. A model that
was made by merges has ranks instead of log scores; they are turned into log scores by the law of rank
and frequency, log(1 / (rank + 1)) less a constant that makes the shares sum to 1. No score is trained here.
Spaces become markers and one marker goes before the text. Where no piece has a marker after another
character, which is tested when a model is loaded, the best path of a text is the best paths of its words
one after another, and words are encoded once for each task while they are in its bounded memory. A character that no piece covers costs
10 less than the least score and is written as its UTF-8 bytes' pieces.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import small_batches

MARK = "▁"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
MERGES = 2  # a model's type
UNKNOWN_PENALTY = 10.0
MEMORY_WORDS = 500_000
GROUP_CHARS = 2_000_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) of a SentencePiece model file, in the order of ids.

    A model that rewrites characters (a normaliser with a map) is a ValueError, as texts are encoded as they are."""
    found, merged = [], False
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                x = dict(_fields(value))
                found.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                merged = dict(_fields(value)).get(3) == MERGES
            elif number == 3 and dict(_fields(value)).get(2):
                raise ValueError(f"{path} rewrites characters before encoding")
    return log_scores(found) if merged else found


def log_scores(ranked: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Pieces whose scores are negated ranks, with log scores by the law of rank and frequency."""
    total = sum(1 / (1 - s) for _, s, kind in ranked if kind == NORMAL)
    return [(p, -float(np.log((1 - s) * total)) if kind == NORMAL else s, kind) for p, s, kind in ranked]


def double_array(keys: dict[bytes, int]) -> tuple[array, array, array]:
    """base, check, value: node n goes on by byte c to base[n] + c, if check there is n; value is the key's number or -1."""
    tree: list[dict[int, int]] = [{}]
    value_of = [-1]
    for key, number in keys.items():
        node = 0
        for c in key:
            if c not in tree[node]:
                tree[node][c] = len(tree)
                tree.append({})
                value_of.append(-1)
            node = tree[node][c]
        value_of[node] = number
    base, check, value = array("i", [0]), array("i", [0]), array("i", [value_of[0]])
    taken = bytearray(1)
    taken[0] = 1

    def grow(size: int) -> None:
        more = size - len(check)
        if more > 0:
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)
            taken.extend(bytes(more))

    # single branches fill the first free places; wider nodes go on where the last of them was put
    free, wide, todo, ends = 257, 257, [(0, 0)], []  # todo: node of the tree, its place
    while todo:
        node, place = todo.pop()
        kids = tree[node]
        if not kids:
            ends.append(place)
            continue
        low = min(kids)
        at = free if len(kids) == 1 else max(free, wide)
        while True:
            grow(at - low + 257)
            if at >= low + 1 and not any(taken[at - low + c] for c in kids):
                break
            at += 1
        begin = at - low
        if len(kids) > 1:
            wide = at
        base[place] = begin
        for c, kid in kids.items():
            taken[begin + c] = 1
            check[begin + c] = place
            value[begin + c] = value_of[kid]
            todo.append((kid, begin + c))
        while free < len(taken) and taken[free]:
            free += 1
    for place in ends:  # leaves go on to places that belong to no node, so a walk needs no other test
        base[place] = len(check)
    grow(len(check) + 256)
    return base, check, value


@dataclass
class Vocabulary:
    """Arrays of bounded size: some ten bytes for each byte of the pieces."""

    pieces: list[bytes]
    scores: list[float]
    base: array
    check: array
    value: array
    byte_ids: list[int]
    unknown: int
    by_words: bool = True  # whether no piece goes from one word into the next

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        found = read_pieces(path)
        keys = {p.encode(): i for i, (p, _, kind) in enumerate(found) if kind in (NORMAL, USER_DEFINED) and p}
        byte_ids = [-1] * 256
        plain = []
        for i, (p, _, kind) in enumerate(found):
            if kind == BYTE:
                byte_ids[int(p[3:5], 16)] = i
            plain.append(bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
        unknown = next((i for i, (_, _, kind) in enumerate(found) if kind == 2), 0)
        return cls(plain, [s for _, s, _ in found], *double_array(keys), byte_ids, unknown, not any(MARK in p.lstrip(MARK) for p, _, kind in found if kind in (NORMAL, USER_DEFINED)))


class Coder:
    """Encodes and decodes with a vocabulary; made once in each task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.base, self.check, self.value = (np.array(x, dtype=np.int64) for x in (v.base, v.check, v.value))
        scores = np.array([*v.scores, -np.inf])
        self.gain = scores[self.value]  # nodes without a piece have -1, the last
        self.unknown_score = float(min(self.gain[self.value >= 0], default=0.0)) - UNKNOWN_PENALTY
        self.longest = max(map(len, v.pieces), default=0) + 2 * max((p.count(b" ") for p in v.pieces), default=0)  # in UTF-8, where a marker is three bytes
        self.words: dict[str, bytes] = {}

    def best_paths(self, texts: list[bytes]) -> list[bytes]:
        """Ids (32-bit) of the best path of each text: the greatest sum of scores; the first found, if several have it.

        The texts advance together, a byte at a time, the longest first."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        size = np.array([len(texts[i]) for i in order])
        width = int(size[0]) + 1
        data = np.frombuffer(b"".join([texts[i].ljust(width, b"\0") for i in order]), dtype=np.uint8)
        best = np.full(len(data), -np.inf)  # text i has the places from i * width
        best[::width] = 0.0
        came, by = np.zeros(len(data), dtype=np.int64), np.full(len(data), -1, dtype=np.int64)
        lead = 1 + (data >= 0xC0).astype(np.int64) + (data >= 0xE0) + (data >= 0xF0)
        begins = (data & 0xC0) != 0x80
        within = width * np.searchsorted(-size, -np.arange(width), side="left")  # where the texts longer than each place end
        for at in range(width - 1):
            starts = np.arange(at, at + within[at], width)
            starts = starts[begins[starts]]
            here, after, whole = best[starts], starts + lead[starts], np.zeros(len(starts), dtype=bool)
            live, to, node = np.arange(len(starts)), starts, np.zeros(len(starts), dtype=np.int64)
            for end in range(at + 1, min(width, at + 1 + self.longest)):
                n = np.searchsorted(to, within[end - 1])  # the others have ended
                step = self.base[node[:n]] + data[to[:n]]
                ok = np.flatnonzero(self.check[step] == node[:n])
                if not len(ok):
                    break
                live, to, node = live[ok], to[ok] + 1, step[ok]
                some = np.flatnonzero(self.value[node] >= 0)
                place, score = to[some], here[live[some]] + self.gain[node[some]]
                whole[live[some[after[live[some]] == place]]] = True
                better = np.flatnonzero(score > best[place])
                place = place[better]
                best[place], came[place], by[place] = score[better], at, self.value[node[some[better]]]
            after, score = after[~whole], here[~whole] + self.unknown_score
            better = score > best[after]
            after = after[better]
            best[after], came[after], by[after] = score[better], at, -1
        best, came, by = (x.reshape(-1, width) for x in (best, came, by))
        out = [b""] * len(texts)
        place, steps, text = size.copy(), [], np.arange(len(texts))
        while len(text):
            at = place[text]
            steps.append((text, by[text, at], came[text, at], at))
            place[text] = came[text, at]
            text = text[place[text] > 0]
        if not steps:
            return out
        texts_, ids, begin, end = (np.concatenate(x) for x in zip(*reversed(steps), strict=True))
        sort = np.argsort(texts_, kind="stable")
        ids, spans = ids[sort].astype(np.int32), np.append(0, np.cumsum(np.bincount(texts_, minlength=len(texts))))
        fallback = {int(texts_[i]) for i in sort[ids < 0]}
        flat, begin, end = ids.tobytes(), begin[sort], end[sort]
        for k, i in enumerate(order):
            lo, hi = spans[k], spans[k + 1]
            if k in fallback:
                own = [self._covered(ids[j], texts[i][begin[j] : end[j]]) for j in range(lo, hi)]
                out[i] = np.array([x for part in own for x in part], dtype=np.int32).tobytes()
            else:
                out[i] = flat[4 * lo : 4 * hi]
        return out

    def best_path(self, data: bytes) -> bytes:
        """The same for a text of any length by itself, a place at a time."""
        n = len(data)
        best, came, by = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value = self.v.base, self.v.check, self.v.value
        at = 0
        while at < n:
            c = data[at]
            after = at + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            here, whole, node, end = best[at], False, 0, at
            for c in data[at : at + self.longest]:
                to = base[node] + c
                if check[to] != node:
                    break
                node, end = to, end + 1
                if value[to] >= 0:
                    score = here + self.v.scores[value[to]]
                    if score > best[end]:
                        best[end], came[end], by[end] = score, at, value[to]
                    whole = whole or end == after
            if not whole and here + self.unknown_score > best[after]:
                best[after], came[after], by[after] = here + self.unknown_score, at, -1
            at = after
        out: list[list[int]] = []
        while n:
            out.append(self._covered(by[n], data[came[n] : n]))
            n = came[n]
        return array("i", [x for part in reversed(out) for x in part]).tobytes()

    def _covered(self, piece: int, data: bytes) -> list[int]:
        """The piece, or the byte pieces of a character without one."""
        if piece >= 0:
            return [int(piece)]
        ids = [self.v.byte_ids[c] for c in data]
        return ids if min(ids) >= 0 else [self.v.unknown]

    @staticmethod
    def keys(text: str) -> list[str]:
        """The words of a text, each with the spaces before it except one; the last may be spaces only."""
        found = text.split(" ") if text else []
        if "" not in found:
            return found
        out, gap = [], 0
        for word in found:
            if word:
                out.append(" " * gap + word)
                gap = 0
            else:
                gap += 1
        return out + [" " * (gap - 1)] * (gap > 0)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids (32-bit) of each text. The words that are new go through the trie together."""
        keys = [self.keys(t) if self.v.by_words else [t] * bool(t) for t in texts]
        words = self.words
        if len(words) > MEMORY_WORDS:
            words.clear()
        new = sorted({k for own in keys for k in own if k not in words}, key=len)
        begin = 0
        while begin < len(new):
            most = max(1, min(4096, 262_144 // (len(new[begin]) + 1)))
            end = begin + most
            while end > begin + 1 and len(new[min(end, len(new)) - 1]) > 2 * len(new[begin]) + 8:
                end = begin + (end - begin) // 2
            part = new[begin:end]
            found = [(MARK + k.replace(" ", MARK)).encode() for k in part]
            words.update(zip(part, [self.best_path(found[0])] if len(part) == 1 else self.best_paths(found), strict=True))
            begin = end
        return [b"".join(map(words.__getitem__, own)) for own in keys]

    def encode(self, text: str) -> array:
        return array("i", self.encode_all([text])[0])

    def decode(self, ids: array) -> str:
        """The text of ids: markers are spaces, byte pieces join to UTF-8, and the first space goes."""
        pieces = self.v.pieces
        text = b"".join([pieces[i] for i in ids]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_CODERS: dict[int, Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """The coder of this Python worker, with the words it has met in earlier tasks."""
    if id(vocabulary) not in _CODERS:  # the coder keeps its vocabulary, so the id stays its own
        _CODERS.clear()
        _CODERS[id(vocabulary)] = Coder(vocabulary)
    return _CODERS[id(vocabulary)]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes (pieces of byte fallback), round_trip for each row of docs.

    round_trip says whether decoding gives the text back: true for every text without a marker
    character of its own. A null text gives no pieces, like an empty one. Repeated rows and null ids are
    rows like others; extra columns are ignored; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # bounded by the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        is_byte = np.zeros(len(shared.value.pieces), dtype=bool)
        is_byte[[i for i in shared.value.byte_ids if i >= 0]] = True
        for batch in batches:
            doc_ids, first, texts, chars = batch.column("doc_id"), 0, [], 0
            for row, text in enumerate(batch.column("text")):
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars > GROUP_CHARS or row == batch.num_rows - 1:
                    own = coder.encode_all(texts)
                    same = [coder.decode(memoryview(x).cast("i")) == t for x, t in zip(own, texts, strict=True)]
                    flat, at = np.frombuffer(b"".join(own), dtype=np.int32), np.append(0, np.cumsum([len(x) // 4 for x in own])).astype(np.int32)
                    n_bytes = np.diff(np.append(0, np.cumsum(is_byte[flat]))[at])
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(first, row + 1 - first), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(np.diff(at).astype(np.int64)), pa.array(n_bytes.astype(np.int64)), pa.array(same, pa.bool_())],
                        names=["doc_id", "ids", "n_pieces", "n_bytes", "round_trip"],
                    )
                    first, texts, chars = row + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_bytes long, round_trip boolean")
