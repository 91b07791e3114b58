"""Periodic runs of words, found by probing harmonic grids.

A run is a stretch of consecutive words that repeats with a smallest period p, at
least ``times`` times (three or more) and over ``least`` words or more, and that no
neighbouring word extends.  Words p apart are then equal over 2p places or more, so
at least two neighbouring points jp and (j+1)p of the grid of p lie among them: each
period has its grid probed, n/p words for period p, n log n for all periods.  What
survives both probes is compared in chunks that grow, from one grid point to the
next, and left at the first chunk that differs; stretches that hold are extended in
both directions in the same way.

Periods are taken by powers of two, the smallest first.  Grid points within a run that
is known and whose period divides p are skipped: what they would lead to is that run
again, as a stretch with two periods that fit in it has their greatest common divisor as a
period too.  For the same reason a stretch found again under a multiple of its period
is recognised by its bounds.

Words are compared by 64-bit hashes.  All texts of a slice are probed at once; a
worker holds the words of one slice, and grid points by blocks.

Defined cases: a null text has no words, no runs and an empty collapsed text; a text of
any length is one whole; runs that overlap are all reported, by start, then period;
repeated rows are rows of their own; an empty table gives no rows; other columns stay,
and the new column takes a name that none of them has, whatever its case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, prepare
from .kernels import NONSPACE, Words, slices

LEAST, TIMES = 24, 3
#: Grid points probed at once, and words of one comparison.
BLOCK, CHUNK, MOST_CHUNK = 1 << 20, 8, 4096


def _ahead(words: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, step: int, growing: bool = True) -> np.ndarray:
    """How many places from ``at`` on, in direction ``step`` and within ``room``, equal the place a period after them."""
    out, size, active = np.zeros(len(at), np.int64), CHUNK, np.flatnonzero(room > 0)
    while len(active):
        still = []
        for low in range(0, len(active), max(1, BLOCK // size)):
            some = active[low : low + max(1, BLOCK // size)]
            left = room[some] - out[some]
            k = np.minimum(np.arange(size), left[:, None] - 1)
            place = at[some][:, None] + step * (out[some][:, None] + k)
            same = words[place] == words[place + period[some][:, None]]
            whole = same.all(axis=1)
            out[some] += np.where(whole, np.minimum(size, left), same.argmin(axis=1))
            still.append(some[whole & (left > size)])
        active = np.concatenate(still)
        size = min(size * 4, MOST_CHUNK)
    return out


def _known(runs: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which grid points lie, with the place a period later, in the last run that starts at or before them, its period dividing theirs."""
    starts, ends, periods = runs
    last = np.searchsorted(starts, at, side="right") - 1
    own = np.maximum(last, 0)
    return (last >= 0) & (at + period < ends[own]) & (period % periods[own] == 0)


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all runs within the rows bounds[i]:bounds[i+1] of words, by start, then period."""
    if times < 3:
        raise ValueError("runs of fewer than three periods may have no two grid points")
    first, counts = bounds[:-1], np.diff(bounds)
    found, power = [], 1
    while len(rows := np.flatnonzero(counts >= max(least, times * power))):
        most = np.minimum(2 * power - 1, counts[rows] // times)
        each = most - power + 1
        row = np.repeat(rows, each)
        period = power + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        points = (counts[row] - 1) // period - 1
        upto = np.concatenate([[0], np.cumsum(points)])
        new, low = [], 0
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + BLOCK, side="right")) - 1)
            item = np.repeat(np.arange(low, high), points[low:high])
            p = period[item]
            at = first[row[item]] + (np.arange(upto[low], upto[high]) - upto[item]) * p
            keep = np.flatnonzero(words[at] == words[at + p])
            keep = keep[words[at[keep] + p[keep]] == words[at[keep] + 2 * p[keep]]]
            for runs in found:
                keep = keep[~_known(runs, at[keep], p[keep])]
            at, p, item = at[keep], p[keep], item[keep]
            whole = _ahead(words, at + 1, p, p - 1, 1) == p - 1
            at, p, item = at[whole], p[whole], item[whole]
            if len(at):
                follows = (item[1:] == item[:-1]) & (at[1:] == at[:-1] + p[1:])
                opens, closes = np.append(True, ~follows), np.append(~follows, True)
                begin, last, p, of = at[opens], at[closes] + p[closes], p[opens], row[item[opens]]
                start = begin - _ahead(words, begin - 1, p, begin - first[of], -1)
                end = last + p + 1 + _ahead(words, last + 1, p, first[of] + counts[of] - p - last - 1, 1)
                good = end - start >= np.maximum(least, times * p)
                new.append((start[good], end[good], p[good]))
            low = high
        if new:
            start, end, p = (np.concatenate(x) for x in zip(*new))
            order = np.argsort(start, kind="stable")
            if len(order):
                found.append((start[order], end[order], p[order]))
        power *= 2
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    start, end, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    once = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))  # the smallest period of equal bounds
    start, end, p = start[once], end[once], p[once]
    order = np.lexsort((p, start))
    return start[order], (end - start)[order], p[order]


def _collapsed(words: Words, body: np.ndarray, drop: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the kept words of each row, a space between them."""
    kept = np.flatnonzero(~drop)
    upto = np.concatenate([[0], np.cumsum(~drop)])[words.rows]
    out, mark = body.copy(), np.zeros(len(body) + 1, np.int8)
    start, end = words.starts[kept], words.ends[kept].copy()
    after = np.ones(len(kept), bool)  # a kept word comes after it in its row, and so a blank right behind it
    after[upto[1:][np.diff(upto) > 0] - 1] = False
    out[end[after]] = 0x20
    mark[start] += 1
    mark[end[after] + 1] -= 1
    mark[end[~after]] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    sizes = np.concatenate([[0], np.cumsum(inside)])[offsets]
    return out[inside], sizes


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def run_column(texts: pa.Array, least: int = LEAST, times: int = TIMES) -> pa.StructArray:
    """(n_words, runs, collapsed) of each text: a run's words after its first period are left out of the collapsed text."""
    sizes, lists, kept = [], [], []
    for low, high, body, offsets in slices(texts):
        words = Words(body, offsets, NONSPACE, lower=False)
        start, length, period = find_runs(words.hashes(), words.rows, least, times)
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        body, cuts = _collapsed(words, body, np.cumsum(change[:-1]) > 0, offsets)
        bounds = np.searchsorted(start, words.rows)
        row = np.searchsorted(words.rows, start, side="right") - 1
        flat = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - words.rows[row], length, period)], fields=list(RUN))
        sizes.append(pa.array(words.counts, pa.int64()))
        lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat))
        kept.append(pa.StringArray.from_buffers(high - low, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(body)))
    types = [pa.int64(), pa.list_(RUN), pa.string()]
    return pa.StructArray.from_arrays([pa.concat_arrays(x) if x else pa.array([], t) for x, t in zip((sizes, lists, kept), types)], ["n_words", "runs", "collapsed"])


def with_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES) -> tuple[DataFrame, str]:
    """docs with a struct (n_words, runs, collapsed), and its name; runs: array of (start, length, period), in words from 0."""
    prepare(docs.sparkSession)
    name = free_name(docs, "repeats")
    at, names = docs.columns.index(text), [*docs.columns, name]
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, run_column(batch.column(at), least, times)], names=names)

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, kind)])), name
