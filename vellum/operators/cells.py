"""Cells of whole segments: a segment's letters stay together, no cell becomes a row.

A task's helper works out the cells of a few MB of segments at once; what is
grouped by row of the grid are segments, or pieces of them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import DEFAULT_ADVANCE
from .sweeps import GAP, greedy

#: Bytes of text whose cells are worked out at once.
SLICE = 1 << 21

_ROW = ["doc_id", "page", "y"]
_MEASURES = ["a", "x", "min_x", "char_w", "width"]


class Cells(NamedTuple):
    """The glyphs inside their grid, of several segments, in order."""

    segment: np.ndarray
    i: np.ndarray
    x: np.ndarray
    letters: np.ndarray  # their UTF-8
    bounds: np.ndarray  # where each one's letters begin, and the end


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def rounded(values: np.ndarray) -> np.ndarray:
    """Halves go away from 0, as round does in Spark and SQL."""
    whole = np.floor(np.abs(values))
    return np.copysign(whole + (np.abs(values) - whole >= 0.5), values)


def segment_cells(texts: pa.Array, a: np.ndarray, x: np.ndarray, min_x: np.ndarray, char_w: np.ndarray, width: np.ndarray) -> Cells:
    """Cells by rounding, as grid.glyph_cells has them: a letter advances by ``a``, a space by half of it."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = np.flatnonzero((body & 0xC0) != 0x80)
    first = np.searchsorted(starts, offsets - offsets[0])
    segment = np.repeat(np.arange(len(texts)), np.diff(first))
    spaces = np.concatenate([[0], np.cumsum(body[starts] == 32)])
    i = np.arange(len(starts)) - first[segment]
    x0 = x[segment] + a[segment] * (i - 0.5 * (spaces[:-1] - spaces[first[segment]]))
    cell = rounded((x0 - min_x[segment]) / char_w[segment])
    inside = (cell >= 0) & (cell < width[segment])
    sizes = np.diff(np.append(starts, len(body)))
    return Cells(segment[inside], i[inside], cell[inside].astype(np.int64), body[np.repeat(inside, sizes)], np.concatenate([[0], np.cumsum(sizes[inside])]))


def _slices(sizes: np.ndarray):
    """(low, high) of neighbouring rows of about SLICE bytes."""
    part = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(low, high) for low, high in zip(cuts, cuts[1:]) if low < high]


def _bytes(texts: pa.Array) -> np.ndarray:
    return _numpy(pa.compute.fill_null(pa.compute.binary_length(texts), 0))


def _strings(letters: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters))])


_PIECES = "array<struct<x:int,end:int,first:int,text:string>>"
_ARROW_PIECES = pa.list_(pa.struct([("x", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("text", pa.string())]))


def _pieces_of(texts: pa.Array, *measures: np.ndarray) -> pa.Array:
    cells = segment_cells(texts, *measures)
    n, seg, x = len(cells.x), cells.segment, cells.x
    new = np.ones(n, bool)
    new[1:] = (seg[1:] != seg[:-1]) | (cells.i[1:] != cells.i[:-1] + 1) | (np.abs(x[1:] - x[:-1]) - 1 > GAP)
    at = np.flatnonzero(new)
    bounds = cells.bounds[np.append(at, n)]
    low, high = (np.minimum.reduceat(x, at), np.maximum.reduceat(x, at) + 1) if n else (x, x)
    first = at - np.searchsorted(seg, seg[at])
    fields = [*(pa.array(v.astype(np.int32)) for v in (low, high, first)), _strings(cells.letters, bounds)]
    upto = np.searchsorted(seg[at], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays(fields, fields=list(_ARROW_PIECES.value_type)))


def _pieces(texts: pa.Array, *measures: pa.Array) -> pa.Array:
    """Each segment's cells as pieces that no wide gap divides: hull, number of the first one's glyph among the segment's cells, letters."""
    measures = [_numpy(m) for m in measures]
    return pa.concat_arrays([pa.array([], _ARROW_PIECES), *[_pieces_of(texts[low:high], *[m[low:high] for m in measures]) for low, high in _slices(_bytes(texts))]])


_WRITTEN = "struct<n:int,first_x:int,last_x:int,text:string>"
_ARROW_WRITTEN = pa.struct([("n", pa.int32()), ("first_x", pa.int32()), ("last_x", pa.int32()), ("text", pa.string())])


def _by_row(writers: pa.Array, row_measures: list[np.ndarray]):
    """For each slice of rows: (rows, the row of each cell, cells, segments of writers) of lists of (seq, text, x, a, ...)."""
    lists = _numpy(writers.value_lengths())
    inner = writers.flatten()
    upto = np.concatenate([[0], np.cumsum(lists)])
    sizes = np.concatenate([[0], np.cumsum(_bytes(inner.field("text")))])
    for low, high in _slices(np.diff(sizes[upto])):
        own = inner[upto[low] : upto[high]]
        row = np.repeat(np.arange(high - low), lists[low:high])
        cells = segment_cells(own.field("text"), _numpy(own.field("a")), _numpy(own.field("x")), *[m[low:high][row] for m in row_measures])
        yield high - low, row[cells.segment], cells, own


def _last_written(writers: pa.Array, *measures: pa.Array) -> pa.Array:
    """Each row's cells, the last writer of a cell winning."""
    out = [pa.array([], _ARROW_WRITTEN)]
    for rows, row, cells, _ in _by_row(writers, [_numpy(m) for m in measures]):
        order = np.lexsort((cells.x, row))  # stable: the last of a cell is its last writer
        r, x = row[order], cells.x[order]
        last = np.ones(len(order), bool)
        last[:-1] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
        won, r, x = order[last], r[last], x[last]
        sizes = np.diff(cells.bounds)[won]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        letters = cells.letters[np.repeat(cells.bounds[won] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        upto = np.searchsorted(r, np.arange(rows + 1))
        ends = np.append(x, 0)
        first, final = ends[upto[:-1]], ends[np.maximum(upto[1:] - 1, 0)]
        fields = [*(pa.array(v.astype(np.int32)) for v in (np.diff(upto), first, final)), _strings(letters, bounds[upto])]
        out.append(pa.StructArray.from_arrays(fields, fields=list(_ARROW_WRITTEN)))
    return pa.concat_arrays(out)


_REGIONS = "array<struct<x:int,width:int,region_id:long,text:string>>"
_ARROW_REGIONS = pa.list_(pa.struct([("x", pa.int32()), ("width", pa.int32()), ("region_id", pa.int64()), ("text", pa.string())]))


def _exact(writers: pa.Array, *measures: pa.Array) -> pa.Array:
    """Each row's regions, grown as cells come."""
    out = [pa.array([], _ARROW_REGIONS)]
    for rows, row, cells, own in _by_row(writers, [_numpy(m) for m in measures]):
        upto = np.searchsorted(row, np.arange(rows + 1)).tolist()
        number = _numpy(own.field("base"))[cells.segment] + np.arange(len(row)) - np.searchsorted(cells.segment, cells.segment)
        found = []
        for low, high in zip(upto, upto[1:]):
            text = cells.letters[cells.bounds[low] : cells.bounds[high]].tobytes().decode(errors="replace")
            found.append([dict(zip(("x", "width", "region_id", "text"), r)) for r in greedy(number[low:high], cells.x[low:high], text)])
        out.append(pa.array(found, _ARROW_REGIONS))
    return pa.concat_arrays(out)


def _helper(function, returns: str):
    return F.arrow_udf(lambda *columns: function(*columns), returns)


def placed(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Segments with their row ``y`` of their page's grid, its measures and their letters' advance ``a``; dealt out by page."""
    of_page = segments.join(sizes, ["doc_id", "page"]).repartition("doc_id", "page")
    advance = F.when(F.length("text") > 0, F.col("w") / F.length("text")).otherwise(DEFAULT_ADVANCE).cast("double")
    y = F.round((F.col("y") - F.col("min_y")) / F.col("char_h")).cast("int")
    rows = of_page.select("doc_id", "page", "seq", "text", advance.alias("a"), F.col("x").cast("double").alias("x"), "min_x", "char_w", "width", "height", y.alias("y"))
    return rows.where("y >= 0 and y < height and length(text) > 0").drop("height")


def _numbered(segments: DataFrame) -> DataFrame:
    """placed segments with their pieces, and ``base``: cells of their page before them."""
    cut = segments.withColumn("pieces", _helper(_pieces, _PIECES)("text", *_MEASURES))
    n = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + F.length(p["text"]))
    before = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("base", F.coalesce(F.sum(n).over(before), F.lit(0)))


def pieces(segments: DataFrame) -> DataFrame:
    """(doc_id, page, y, x, end, region_id, text) of placed segments: the cells that they fill, as many at once as no wide gap divides."""
    each = _numbered(segments).select(*_ROW, "base", F.explode("pieces").alias("p"))
    return each.select(*_ROW, F.col("p.x").alias("x"), F.col("p.end").alias("end"), (F.col("base") + F.col("p.first")).alias("region_id"), F.col("p.text").alias("text"))


def _rows(segments: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page, y, w, min_x, char_w, width): each row's segments in order."""
    writers = F.array_sort(F.collect_list(F.struct("seq", "text", "x", "a", *more)))
    return segments.groupBy(*_ROW).agg(writers.alias("w"), *[F.first(c).alias(c) for c in ("min_x", "char_w", "width")])


def last_writer_rows(segments: DataFrame) -> DataFrame:
    """(doc_id, page, y, n, first_x, last_x, text) of placed segments, as cell_rows has it of last_writer's cells."""
    found = _rows(segments).select(*_ROW, _helper(_last_written, _WRITTEN)("w", "min_x", "char_w", "width").alias("c"))
    return found.select(*_ROW, "c.*").where("n > 0")


def exact_regions(segments: DataFrame) -> DataFrame:
    """(doc_id, page, y, x, width, region_id, text) of placed segments, as merge_exact has it of their cells."""
    found = _rows(_numbered(segments).drop("pieces"), "base").select(*_ROW, F.explode(_helper(_exact, _REGIONS)("w", "min_x", "char_w", "width")).alias("r"))
    return found.select(*_ROW, "r.*")
