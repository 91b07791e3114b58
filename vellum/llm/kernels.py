"""Byte-level numpy kernels over Arrow string columns.

Every kernel works on slices of whole texts: a batch is cut between rows into
slices of about ``SLICE_BYTES``, a longer text being a slice of its own, so a
worker holds the arrays of one slice at a time.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_LETTERS = np.arange(256, dtype=np.uint8)
LOWER = np.where((_LETTERS >= 65) & (_LETTERS <= 90), _LETTERS + 32, _LETTERS).astype(np.uint8)
#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
ALNUM = ((_LETTERS >= 0x30) & (_LETTERS <= 0x39)) | ((_LETTERS >= 0x61) & (_LETTERS <= 0x7A)) | (_LETTERS >= 0x80)
#: Word bytes of the class [^\x20\x09-\x0D].
NONSPACE = ~((_LETTERS == 0x20) | ((_LETTERS >= 0x09) & (_LETTERS <= 0x0D)))

_BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D  # odd, so that it has an inverse modulo 2**64
_GRAM = U64(0x9FB21C651E98DF25)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n, grown by doubling."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(SLICE_BYTES, 1 << max(0, n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.empty(size, dtype=U64)
            table[0], filled, step = 1, 1, base
            while filled < size:
                take = min(filled, size - filled)
                table[filled : filled + take] = table[:take] * U64(step)
                filled, step = filled + take, step * step % (1 << 64)
            _powers[key] = table
    return _powers["up"], _powers["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    elif pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body, at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive slices."""
    body, at = text_buffers(column)
    n, low = len(at) - 1, 0
    while low < n:
        high = int(np.searchsorted(at, at[low] + most, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, body[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


class Words:
    """Words of a slice: byte ranges and the range of words of each row."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.bytes = LOWER[body] if lower else body
        inside = kind[self.bytes]
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        if n:
            breaks = offsets[(offsets > 0) & (offsets < n)]
            before, after = inside[:-1].copy(), inside[1:].copy()
            before[breaks - 1] = False
            after[breaks - 1] = False
            first[1:] &= ~before
            last[:-1] &= ~after
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)  # row i has words rows[i]:rows[i+1]
        self.counts = np.diff(self.rows)
        self.inside = inside

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.empty(0, U64)
        up, down = _power_tables(len(self.bytes))
        codes = _BYTE_CODES[self.bytes] * up[: len(self.bytes)]
        codes[~self.inside] = 0
        return mix64(np.add.reduceat(codes, self.starts) * down[self.starts])

    def prefix_hashes(self, lengths: tuple[int, ...]) -> list[np.ndarray]:
        """For each length a hash of each word's first so many bytes; 0 for a word that has no more than those."""
        if not len(self.starts):
            return [np.empty(0, U64) for _ in lengths]
        up, down = _power_tables(len(self.bytes))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE_CODES[self.bytes] * up[: len(self.bytes)])])
        sizes, out = self.ends - self.starts, []
        for length in lengths:
            own = np.zeros(len(self.starts), U64)
            some = np.flatnonzero(sizes > length)
            at = self.starts[some]
            own[some] = mix64((total[at + length] - total[at]) * down[at] + U64(length))
            out.append(own)
        return out


def grams(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words; runs across rows are for the caller to leave out."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for j in range(1, length):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix64(out + U64(length))


def gram_at(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The same hashes at chosen starts only."""
    out = hashes[starts].copy()
    for j in range(1, length):
        out *= _GRAM
        out += hashes[starts + j]
    return mix64(out + U64(length))


def shingle_sets(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, joined, and the row offsets.

    A row with fewer than ``length`` words, but not none, has its whole word
    sequence as its one shingle.
    """
    hashes, rows, counts = words.hashes(), words.rows, words.counts
    every = grams(hashes, length)
    sizes = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], U64)
    for i in range(len(counts)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            continue
        if counts[i] >= length:
            out[a:b] = every[rows[i] : rows[i] + (b - a)]
            out[a:b].sort()
        else:
            out[a] = grams(hashes[rows[i] : rows[i + 1]], int(counts[i]))[0]
    if len(out):
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[bounds[:-1][sizes > 0]] = True
        total = np.concatenate([[0], np.cumsum(keep)])
        out, bounds = out[keep], total[bounds]
    return out, bounds


def substrings(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings at body[start:start+size]."""
    cuts = np.concatenate([[0], np.cumsum(size)])
    letters = body[np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cuts), pa.py_buffer(letters)).cast(pa.string())
