"""Words and word hashes of whole texts, computed on the bytes of Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is the same as a run of such
code points in UTF-8. All hashes are 64-bit and depend on nothing but the word's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_STEP = U(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _STEP
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """The words of some texts: their byte spans, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        """data: the texts' bytes one after another; offsets: where each starts, and the end."""
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~SPACE[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        if n:
            starts, ends = offsets[:-1], offsets[1:]
            before[starts[starts < n]] = False
            after[ends[ends > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        #: first[i]: number of the first word of text i; first[-1]: number of words
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            self.hash = self._hashes(solid, _BYTE_LOWER if lower else _BYTE)

    def _hashes(self, solid: np.ndarray, codes: np.ndarray) -> np.ndarray:
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, dtype=np.uint64)
        at = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(at, length)
        h = codes[self.data[solid]] * _powers(int(length.max()))[place]
        return mix(np.add.reduceat(h, at) + length.astype(np.uint64))

    def of_text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; also those that cross from one text into the next."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = h * U(0x9FB21C651E98DF25) + words[j : j + n]
    return mix(h)


def chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow string column in runs of about `most` bytes: (first row, end row, bytes, offsets).

    A null counts as an empty text. One text is never cut, so a run may hold a single longer one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
