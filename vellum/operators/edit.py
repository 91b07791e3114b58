"""Edits of character grids, a row of text at a time, and of running texts.

Selections are (doc_id, r0, c0, r1, c1), any corner first, both ends included; rows
are (doc_id, row_idx, text).  Rows join selections by document; what the edit does
within a row is string work, so no cell is ever made a row of its own.

Where grid and selection come together, as ``marked`` grids, edits take place within
a grid's ragged lines: only what is selected is cut out and padded, rows unfold
once, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_at, common_indent_removed, is_block, pad, put_at, put_growing, sanitise, text_lines
from .bins import Axis, overlap_join

MOST_CELLS = 100_000
TOO_LARGE = "[Selection too large]"


def normalised(selections: DataFrame, grids: DataFrame) -> DataFrame:
    """Selections with their first corner above and left, rows cut to the grid (doc_id, height), and their area."""
    return marked(selections.join(grids.select("doc_id", "height"), "doc_id")).select("doc_id", "top", "bottom", "left", "right", "area")


def marked(grids: DataFrame) -> DataFrame:
    """Grids with their selection (r0, c0, r1, c1) as top, bottom, left, right and area."""
    last = F.greatest(F.col("height") - 1, F.lit(0))
    corners = {"top": F.least("r0", "r1", last), "bottom": F.least(F.greatest("r0", "r1"), last), "left": F.least("c0", "c1"), "right": F.greatest("c0", "c1")}
    out = grids.withColumns({c: v.cast("int") for c, v in corners.items()}).drop("r0", "c0", "r1", "c1")
    return out.withColumn("area", (F.col("bottom") - F.col("top") + 1).cast("long") * (F.col("right") - F.col("left") + 1))


def fits() -> Column:
    return F.col("area") <= MOST_CELLS


def selection(padded: bool = False) -> Column:
    """The selected part of each selected row of a marked grid, as far as the grid goes or filled up with spaces."""
    size = F.col("right") - F.col("left") + 1
    reach = size if padded else F.least(size, F.greatest(F.col("width").cast("int") - F.col("left"), F.lit(0)))
    part = lambda x: pad(F.substring(x, F.col("left") + 1, size), reach)
    return F.transform(F.slice("lines", F.col("top") + 1, F.col("bottom") - F.col("top") + 1), part)


def clip() -> Column:
    """What a copy of the selection holds: nothing if that is too large."""
    return F.coalesce(F.when(fits(), selection()), F.expr("cast(array() as array<string>)"))


def copied_grids(grids: DataFrame, padded: bool = False) -> DataFrame:
    """copied, for marked grids."""
    return grids.select("doc_id", F.when(fits(), F.array_join(selection(padded), "\n")).otherwise(F.lit(TOO_LARGE)).alias("text"))


def _without_selection(row: Column, text: Column) -> Column:
    inside = fits() & row.between(F.col("top"), F.col("bottom"))
    return F.when(inside, blank_at(text, F.col("left"), F.col("right") + 1)).otherwise(text)


def cut_grids(grids: DataFrame) -> DataFrame:
    """cut_out, for marked grids."""
    rows = grids.select("doc_id", "width", "top", "bottom", "left", "right", "area", F.posexplode("lines").alias("row_idx", "line"))
    return rows.select("doc_id", "row_idx", _without_selection(F.col("row_idx"), pad(F.col("line"), F.col("width"))).alias("text"))


def pasted_grids(grids: DataFrame, piece: Column, row: Column, col: Column, new_width: Column | None = None, cut: bool = False) -> DataFrame:
    """pasted for an array of rows, put at (row, col) of its own grid; with ``new_width`` as pasted_growing, with ``cut`` after the selection is cut out."""
    pieces = F.concat(F.array_repeat(F.lit(None).cast("string"), row.cast("int")), piece)
    keep = ["top", "bottom", "left", "right", "area"] if cut else []
    wide = grids.withColumn("_col", col.cast("int")).withColumn("_new", (F.lit(0) if new_width is None else new_width).cast("int"))
    rows = wide.select("doc_id", "width", "_col", "_new", *keep, F.posexplode(F.arrays_zip(F.col("lines").alias("line"), pieces.alias("piece"))).alias("row_idx", "z"))
    line, piece = F.col("z.line"), F.col("z.piece")
    if new_width is None:
        rows = rows.where(line.isNotNull())
    text = F.coalesce(pad(line, F.col("width")), F.repeat(F.lit(" "), F.col("_new")))
    # padded once, before the branches that read it
    rows = rows.select("doc_id", "row_idx", "_col", *keep, piece.alias("_piece"), text.alias("_text"))
    if cut:
        rows = rows.withColumn("_text", _without_selection(F.col("row_idx"), F.col("_text")))
    put = put_at if new_width is None else put_growing
    return rows.select("doc_id", "row_idx", F.when(F.col("_piece").isNotNull(), put(F.col("_text"), F.col("_col"), F.col("_piece"))).otherwise(F.col("_text")).alias("text"))


def pasted_text(grids: DataFrame, text: Column, row: Column, col: Column) -> DataFrame:
    """Rows after a text of another program is pasted at (row, col), the grid growing.

    A rectangular block, by ``is_block``, loses its common indent; other texts go in line
    by line, an empty one as a space.  New rows are 80 columns wide at least.
    """
    held = grids.withColumn("_lines", text_lines(sanitise(text)))
    held = held.withColumn("_block", is_block(F.col("_lines")))
    plain = F.when(F.size("_lines") == 0, F.array(F.lit(" "))).otherwise(F.col("_lines"))
    clip = F.when(F.col("_block"), common_indent_removed(F.col("_lines"))).otherwise(plain)
    return pasted_grids(held, clip, row, col, F.greatest(F.col("width"), F.lit(80)))


def select_all(docs: DataFrame) -> DataFrame:
    """docs with the range [sel_start, sel_end) of all their characters."""
    return docs.withColumn("sel_start", F.lit(0)).withColumn("sel_end", F.length("text"))


def selected_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def selected_rows(rows: DataFrame, marks: DataFrame, padded: bool) -> DataFrame:
    """(doc_id, row_off, text): the selected part of each selected row, ragged or filled up with spaces."""
    hit = rows.join(marks, "doc_id").where(F.col("row_idx").between(F.col("top"), F.col("bottom")))
    width = F.col("right") - F.col("left") + 1
    part = F.substring(F.col("text"), F.col("left") + 1, width)
    return hit.select("doc_id", (F.col("row_idx") - F.col("top")).alias("row_off"), (F.rpad(part, width, F.lit(" ")) if padded else part).alias("text"), "area")


#: Rows of one cell of many_selected.
BAND = 64


def many_selected(rows: DataFrame, selections: DataFrame, padded: bool = True) -> DataFrame:
    """(sel_id, doc_id, row_off, text): the selected part of each row of each selection (sel_id, doc_id, r0, c0, r1, c1), of which a document may have very many."""
    corners = {"top": F.least("r0", "r1"), "bottom": F.greatest("r0", "r1"), "left": F.least("c0", "c1"), "right": F.greatest("c0", "c1")}
    marks = selections.select("sel_id", "doc_id", *[v.cast("int").alias(c) for c, v in corners.items()])
    hit = overlap_join(rows, marks, ["doc_id"], [Axis(F.col("row_idx"), F.col("row_idx"), F.col("top"), F.col("bottom"), BAND)])
    width = F.col("right") - F.col("left") + 1
    part = F.substring(F.col("text"), F.col("left") + 1, width)
    return hit.select("sel_id", "doc_id", (F.col("row_idx") - F.col("top")).alias("row_off"), (pad(part, width) if padded else part).alias("text"))


def copied(rows: DataFrame, marks: DataFrame, padded: bool = False) -> DataFrame:
    """(doc_id, text): the selection as text; selections of too many cells give a note instead."""
    # too large ones are left out before their rows are gathered
    parts = selected_rows(rows, marks.where(F.col("area") <= MOST_CELLS), padded)
    ordered = F.array_sort(F.collect_list(F.struct("row_off", "text")))
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return joined.union(marks.where(F.col("area") > MOST_CELLS).select("doc_id", F.lit(TOO_LARGE).alias("text")))


def cut_out(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with the selection blank; selections of too many cells do nothing."""
    joined = rows.join(marks.where(F.col("area") <= MOST_CELLS), "doc_id", "left")
    inside = F.coalesce(F.col("row_idx").between(F.col("top"), F.col("bottom")), F.lit(False))
    return joined.select("doc_id", "row_idx", F.when(inside, blank_at(F.col("text"), F.col("left"), F.col("right") + 1)).otherwise(F.col("text")).alias("text"))


def pasted(rows: DataFrame, clip: DataFrame, at: DataFrame) -> DataFrame:
    """Rows with the clip's rows (doc_id, row_off, text) written over them from (doc_id, row, col); what lies outside is cut."""
    placed = clip.join(at, "doc_id").select("doc_id", (F.col("row") + F.col("row_off")).alias("row_idx"), F.col("col").alias("_at"), F.col("text").alias("_piece"))
    joined = rows.join(placed, ["doc_id", "row_idx"], "left")
    return joined.select("doc_id", "row_idx", F.when(F.col("_piece").isNotNull(), put_at(F.col("text"), F.col("_at"), F.col("_piece"))).otherwise(F.col("text")).alias("text"))


def moved(rows: DataFrame, marks: DataFrame, at: DataFrame) -> DataFrame:
    """The selection's cells blank first, then written at the drop."""
    return pasted(cut_out(rows, marks), selected_rows(rows, marks, padded=False).select("doc_id", "row_off", "text"), at)


def pasted_growing(rows: DataFrame, clip: DataFrame, at: DataFrame, new_width: str) -> DataFrame:
    """As pasted, but rows grow, and new rows of ``new_width`` (an expression over the grid's ``width``) spaces come below."""
    placed = clip.join(at, "doc_id").select("doc_id", (F.col("row") + F.col("row_off")).alias("row_idx"), F.col("col").alias("_at"), F.col("text").alias("_piece"))
    size = rows.groupBy("doc_id").agg(F.max("row_idx").alias("last"), F.max(F.when(F.col("row_idx") == 0, F.length("text"))).alias("width"))
    reach = placed.groupBy("doc_id").agg(F.max("row_idx").alias("reach")).join(size, "doc_id").where("reach > last")
    fresh = reach.select("doc_id", F.explode(F.sequence(F.col("last") + 1, "reach")).alias("row_idx"), F.repeat(F.lit(" "), F.expr(f"cast({new_width} as int)")).alias("text"))
    joined = rows.union(fresh).join(placed, ["doc_id", "row_idx"], "left")
    return joined.select("doc_id", "row_idx", F.when(F.col("_piece").isNotNull(), put_growing(F.col("text"), F.col("_at"), F.col("_piece"))).otherwise(F.col("text")).alias("text"))


def replayed_cells(edits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each cell: a batch of writes at fixed cells is one aggregation, not a loop over edits."""
    return edits.groupBy(*keys).agg(F.max_by("ch", order).alias("ch"))


def apply_edit(text: str, op: str, start: int, end: int, piece: str) -> str:
    """The text after one edit; one that reaches outside does nothing."""
    if op == "insert" and 0 <= start <= len(text):
        return text[:start] + piece + text[start:]
    if op == "delete" and 0 <= start < end <= len(text):
        return text[:start] + text[end:]
    if op == "replace" and 0 <= start <= end <= len(text):
        return text[:start] + piece + text[end:]
    return text


def typed(rows: DataFrame, keys: DataFrame, grows: bool) -> DataFrame:
    """Rows after one written character (doc_id, row_idx, col, ch) each at most; Backspace and Delete write a space."""
    joined = rows.join(keys, ["doc_id", "row_idx"], "left")
    put = put_growing if grows else put_at
    return joined.select("doc_id", "row_idx", F.when(F.col("ch").isNotNull(), put(F.col("text"), F.col("col"), F.col("ch"))).otherwise(F.col("text")).alias("text"))


def latest(rows: DataFrame, key: str, time: list[str], k: int) -> DataFrame:
    """The k keys used last, the latest first, and their time: what a cache of k places holds."""
    last = rows.groupBy(key).agg(F.max(F.struct(*time)).alias("_t"))
    return last.orderBy(F.desc("_t"), key).limit(k).select(key, *[F.col(f"_t.{c}").alias(c) for c in time])


def row_numbers(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their number, from 0, within ``by``."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
