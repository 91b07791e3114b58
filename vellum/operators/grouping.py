"""Lines from positioned words, regions from cells.

Lines: in order of vpos, a word within 8 points of the current line's first word
joins it, any other starts a line (``anchors``).  Numbers that run through a document are
sums in two levels (``running``): within coarse parts, and over these.

Regions: cells of one row whose hulls are at most 2 apart merge.  For cells that
arrive in order of x that is a gap-and-island pass; the arrival order matters
otherwise, and ``merge_exact`` follows it, in Python for rows that need it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written
from .anchors import anchored
from .bins import Axis, overlap_join
from .running import neighbours, running_sum
from .sweeps import GAP
from .sweeps import greedy as _greedy


#: Lines of one part of a running sum.
LINES = 256


def _running(rows: DataFrame, order: list[str], size, out: str, together: bool) -> DataFrame:
    """rows with the sum of ``size`` over those before them in their document."""
    if together:
        before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)))
    return running_sum(rows, ["doc_id"], F.floor(F.col("line_idx") / LINES), order, size, out)


def spatial_map(elements: DataFrame, together: bool = False) -> DataFrame:
    """(doc_id, line_idx, elem_idx, start_char, end_char, hpos, vpos, content): words in reading order with their character range.

    A word's range has the space after it, unless it is its line's last; a line feed stands between lines.
    together: a document's words stand in one task as they are (``anchors.anchored``).
    """
    placed = anchored(elements, "doc_id", "vpos", together=together)
    in_line = Window.partitionBy("doc_id", "line_idx").orderBy("hpos", "vpos", "ord")
    numbered = placed.withColumn("elem_idx", F.row_number().over(in_line) - 1).withColumn("_more", F.lead("ord").over(in_line).isNotNull())
    size = (F.length("content") + 1).cast("long")  # its own letters, and the space or line feed after it
    out = _running(numbered, ["line_idx", "elem_idx"], size, "start_char", together)
    return out.select("doc_id", "line_idx", "elem_idx", "start_char", (F.col("start_char") + F.length("content") + F.col("_more").cast("int")).alias("end_char"), "hpos", "vpos", "content")


def reading_lines(elements: DataFrame, together: bool = False) -> DataFrame:
    """(doc_id, line_idx, text, start_char, end_char, first_hpos, first_vpos).  together: as for spatial_map."""
    placed = anchored(elements, "doc_id", "vpos", together=together)
    words = F.array_sort(F.collect_list(F.struct("hpos", "vpos", "ord", "content")))
    grouped = placed.groupBy("doc_id", "line_idx").agg(words.alias("w"))
    lines = grouped.select("doc_id", "line_idx", F.array_join(F.transform("w", lambda x: x["content"]), " ").alias("text"), F.get("w", F.lit(0)).alias("f"))
    return _running(lines, ["line_idx"], F.length("text").cast("long") + 1, "start_char", together).select(
        "doc_id", "line_idx", "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"), F.col("f.hpos").alias("first_hpos"), F.col("f.vpos").alias("first_vpos")
    )


def max_vpos(elements: DataFrame) -> DataFrame:
    """(doc_id, max_vpos, bottom): the lowest position, 0 at least, and the terminal row below the content."""
    lowest = elements.groupBy("doc_id").agg(F.greatest(F.max("vpos"), F.lit(0.0)).alias("max_vpos"))
    return lowest.withColumn("bottom", F.floor(F.col("max_vpos") / 12) + 3)


def document_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines of reading_lines joined."""
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def nearest_line(lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """(click_id, doc_id, line_idx, position): the line nearest to a clicked row, the first of equals, and the character there.

    Only the last row of lines up to the click's and the first one after it come into question.
    """
    row = F.greatest(F.floor(F.col("first_vpos") / 12).cast("int"), F.lit(1)).alias("row")
    line = F.min(F.struct("line_idx", "start_char", F.length("text").alias("letters"), "first_hpos")).alias("line")
    near = neighbours(lines.groupBy("doc_id", row).agg(line), clicks, "doc_id", "row")
    of = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("row") - F.col(f"{side}.row")).alias("distance"), *[F.col(f"{side}.line.{c}").alias(c) for c in ("line_idx", "start_char", "letters", "first_hpos")]))
    best = near.select("click_id", "doc_id", "col", F.least(of("before"), of("after")).alias("b")).where("b is not null")
    last = lines.groupBy("doc_id").agg(F.max("line_idx").alias("last"))
    column = F.greatest(F.floor(F.col("b.first_hpos") / 8).cast("int"), F.lit(1))
    # the last character of the document's last line can't be reached: one is taken off for a line feed that it lacks
    reach = F.col("b.letters") - F.when(F.col("b.line_idx") == F.col("last"), F.least(F.lit(1), F.col("b.letters"))).otherwise(0)
    at = F.least(F.greatest(F.col("col") - column, F.lit(0)), reach)
    return best.join(last, "doc_id").select("click_id", "doc_id", F.col("b.line_idx").alias("line_idx"), (F.col("b.start_char") + at).alias("position"))


#: Characters of one cell.
CELL = 4096


def overlapping(spans: DataFrame, selections: DataFrame, together: bool = False) -> DataFrame:
    """Spans that a selection [sel_start, sel_end) of their document touches, once for each of its selections.  together: as for overlap_join."""
    closed = lambda low, high: (F.col(low), F.greatest(F.col(high) - 1, F.col(low)))
    pairs = overlap_join(spans, selections, ["doc_id"], [Axis(*closed("start_char", "end_char"), *closed("sel_start", "sel_end"), CELL)], together)
    return pairs.where((F.col("sel_start") < F.col("end_char")) & (F.col("sel_end") > F.col("start_char")))


def merge_islands(regions: DataFrame) -> DataFrame:
    """(doc_id, page, y, x, width, region_id, text): merged regions of (doc_id, page, region_id, x, y, ch), for cells in order of x within rows."""
    return merge_pieces(regions.select("doc_id", "page", "y", "x", (F.col("x") + 1).alias("end"), "region_id", F.col("ch").alias("text")))


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """As merge_islands, of (doc_id, page, y, x, end, region_id, text): cells from x to before ``end``, numbered from region_id on, that no wide gap divides."""
    row = Window.partitionBy("doc_id", "page", "y")
    order = row.orderBy("x", "region_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("_new", F.when(F.coalesce(F.col("x") - reach > GAP, F.lit(True)), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    letters = F.array_sort(F.collect_list(F.struct("region_id", "text")))
    merged = islands.groupBy("doc_id", "page", "y", "_island").agg(F.min("x").alias("x"), (F.max("end") - F.min("x")).alias("width"), F.min("region_id").alias("region_id"), letters.alias("l"))
    return merged.select("doc_id", "page", "y", "x", "width", "region_id", F.array_join(F.transform("l", lambda c: c["text"]), "").alias("text"))


_ROW = ["doc_id", "page", "y"]
_REGION = "doc_id long, page int, y int, x int, width int, region_id long, text string"


def _ordered_rows(rows: DataFrame) -> DataFrame:
    """Regions of rows (doc_id, page, y, cells) whose cells, an array in order of arrival, are in order of x: cut where a gap is too wide."""
    cells = F.col("cells")
    at = lambda i: F.get(cells, i)["x"]
    # no sequence from 1 down to 0 for a single cell
    cuts = F.when(F.size(cells) > 1, F.filter(F.sequence(F.lit(1), F.size(cells) - 1), lambda i: at(i) - at(i - 1) - 1 > GAP)).otherwise(F.expr("cast(array() as array<int>)"))
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("a"), F.concat(cuts, F.array(F.size(cells))).alias("b"))
    each = rows.select(*_ROW, "cells", F.explode(bounds).alias("p")).select(*_ROW, F.slice(cells, F.col("p.a") + 1, F.col("p.b") - F.col("p.a")).alias("l"))
    first, last = F.get("l", F.lit(0)), F.element_at("l", -1)
    return each.select(*_ROW, first["x"].alias("x"), (last["x"] + 1 - first["x"]).alias("width"), first["region_id"].alias("region_id"), F.array_join(F.transform("l", lambda c: c["ch"]), "").alias("text"))


def _sweeps(rows: DataFrame) -> DataFrame:
    """Regions of rows (doc_id, page, y, cells) in any order."""

    def run(frames):
        for frame in frames:
            out = [
                (doc, page, y, *region)
                for doc, page, y, number, x, ch in zip(frame["doc_id"], frame["page"], frame["y"], frame["number"], frame["x"], frame["ch"])
                for region in _greedy(number, x, ch)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "page", "y", "x", "width", "region_id", "text"])

    part = lambda c: F.transform("cells", lambda cell: cell[c])
    return rows.select(*_ROW, part("region_id").alias("number"), part("x").alias("x"), part("ch").alias("ch")).mapInPandas(run, _REGION)


def merge_exact(regions: DataFrame) -> DataFrame:
    """As merge_islands, for any arrival order: regions grow as cells come.

    Cells are gathered by row of the grid once.  Rows whose cells arrive in order of x are cut
    within Spark; only others are swept, n cells in n log n.
    """
    rows = regions.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct(F.col("region_id").cast("long").alias("region_id"), F.col("x").cast("int").alias("x"), "ch"))).alias("cells"))
    rows = written(rows)
    x = F.transform("cells", lambda c: c["x"])
    ordered = F.array_sort(x) == x
    cast = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _REGION.split(", ")]
    return _ordered_rows(rows.where(ordered)).select(*cast).union(_sweeps(rows.where(~ordered)).select(*cast))
