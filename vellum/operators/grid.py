"""Character grids: from lines, and from glyphs or segments by two rules of who wins a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbered, pad, strip_first_token, text_lines
from ..sources.text_files import write_texts
from .geometry import glyphs

LEAST_ROWS, EMPTY_WIDTH = 25, 80


def text_grid(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, width, height, lines, rows, ...): a text's lines, 25 at least, as they are and padded to the longest line's bytes.

    Operators unfold the ragged ``lines`` and pad what comes out; ``rows`` is made only if it is asked for.  ``keep``: further columns of docs.
    """
    lines = docs.select("doc_id", *keep, text_lines(F.col("text")).alias("l"))
    width = F.coalesce(F.array_max(F.transform("l", lambda x: F.octet_length(x))), F.lit(EMPTY_WIDTH))
    full = F.concat("l", F.array_repeat(F.lit(""), F.greatest(F.lit(LEAST_ROWS) - F.size("l"), F.lit(0))))
    sized = lines.select("doc_id", *keep, width.alias("width"), F.greatest(F.size("l"), F.lit(LEAST_ROWS)).alias("height"), full.alias("lines"))
    return sized.withColumn("rows", padded_rows())


def padded_rows() -> Column:
    """A grid's rows as an array."""
    return F.transform("lines", lambda x: pad(x, F.col("width")))


def grid_rows(grids: DataFrame) -> DataFrame:
    """(doc_id, row_idx, text)."""
    return grids.select("doc_id", "width", F.posexplode("lines").alias("row_idx", "line")).select("doc_id", "row_idx", pad(F.col("line"), F.col("width")).alias("text"))


def saved_text(grids: DataFrame, numbers: bool = False) -> DataFrame:
    """(doc_id, text): each grid as its file's text, its rows after their number from 1 if asked for."""
    row = lambda x, i: numbered(pad(x, F.col("width")), i + 1) if numbers else pad(x, F.col("width"))
    return grids.select("doc_id", F.array_join(F.transform("lines", row), "\n").alias("text"))


def grid_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text): rows joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "text")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def write_grids(grids: DataFrame, folder: str, numbers: bool = False) -> None:
    """Each grid as the text file ``<doc_id>.matrix.txt`` in a new folder."""
    saved = saved_text(grids, numbers)
    write_texts(saved.select(F.concat("doc_id", F.lit(".matrix.txt")).alias("name"), "text"), folder)


def padded_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_idx, text): lines after their first space, padded to the longest."""
    lines = docs.select("doc_id", F.transform(text_lines(F.col("text")), strip_first_token).alias("l"))
    width = F.coalesce(F.array_max(F.transform("l", lambda x: F.length(x))), F.lit(0))
    ragged = lines.withColumn("width", width).select("doc_id", "width", F.posexplode("l").alias("row_idx", "line"))
    return ragged.select("doc_id", "row_idx", pad(F.col("line"), F.col("width")).alias("text"))


def first_of(*extracts: DataFrame) -> DataFrame:
    """(doc_id, text) of the first extract that has a document with any text in it."""
    ranked = [e.where(F.col("text").rlike("\\S")).select("doc_id", F.struct(F.lit(i).alias("rank"), "text").alias("t")) for i, e in enumerate(extracts)]
    every = ranked[0]
    for e in ranked[1:]:
        every = every.union(e)
    return every.groupBy("doc_id").agg(F.min("t").alias("t")).select("doc_id", "t.text")


def filled_cells(grids: DataFrame) -> DataFrame:
    """(doc_id, n): cells that aren't spaces."""
    return grids.select("doc_id", filled().alias("n"))


def filled() -> Column:
    return F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(F.replace(x, F.lit(" "))))


def glyph_cells(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, ch, seq, i): the cell of each glyph inside its page's grid.

    Segments meet their page's measures, and are dealt out by page, before they
    unfold to glyphs, so what follows by page shuffles no glyphs.
    """
    measures = ("width", "height", "char_w", "char_h", "min_x", "min_y")
    placed = glyphs(segments.join(sizes, ["doc_id", "page"]).repartition("doc_id", "page"), keep=measures)
    cell = placed.select(
        "doc_id", "page", "seq", "i", "ch", "width", "height",
        F.round((F.col("x0") - F.col("min_x")) / F.col("char_w")).cast("int").alias("x"), F.round((F.col("y0") - F.col("min_y")) / F.col("char_h")).cast("int").alias("y"),
    ).where("x >= 0 and x < width and y >= 0 and y < height")
    return cell.select("doc_id", "page", "x", "y", "ch", "seq", "i")


def regions(cells: DataFrame) -> DataFrame:
    """Cells with the number of their glyph, from 0, in order."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq", "i")
    return cells.withColumn("region_id", (F.row_number().over(order) - 1).cast("long"))


def last_writer(cells: DataFrame) -> DataFrame:
    """(doc_id, page, y, x, ch): each cell's last writer."""
    return cells.groupBy("doc_id", "page", "y", "x").agg(F.max_by("ch", F.col("seq").cast("long") * (1 << 31) + F.col("i")).alias("ch"))


def cell_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, page, y, n, first_x, last_x, text): a row's cells in order of x."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "ch")))
    return cells.groupBy("doc_id", "page", "y").agg(F.count("*").alias("n"), F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.array_join(F.transform(ordered, lambda c: c["ch"]), "").alias("text"))


def _painted_rows(segments: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, page, y, cells): each row's cells from x = 0, null where nothing is written.

    Segments are dealt out by page while they are whole, and a row's segments, at most
    ``width`` characters of each, are laid over each other in order.
    """
    corner = segments.groupBy("doc_id", "page").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"))
    placed = segments.repartition("doc_id", "page").join(corner, ["doc_id", "page"])
    start, row = F.floor((F.col("x") - F.col("min_x")) / 6).cast("int"), F.floor((F.col("y") - F.col("min_y")) / 12).cast("int")
    room = F.greatest(F.lit(width) - start, F.lit(0))
    fits = placed.select("doc_id", "page", "seq", (F.col("h") > 14).alias("tall"), start.alias("sx"), row.alias("y"), F.substring("text", F.lit(1), room).alias("text")).where((F.col("y") < height) & (F.col("text") != ""))
    writers = fits.groupBy("doc_id", "page", "y").agg(F.array_sort(F.collect_list(F.struct("seq", "tall", "sx", "text"))).alias("w"))

    def lay(under: Column, s: Column) -> Column:
        over = F.concat(F.array_repeat(F.lit(None).cast("string"), s["sx"]), F.split(s["text"], ""))
        wins = lambda a, b: F.when(b.isNull(), a).when(s["tall"] | a.isNull() | (a == " "), b).otherwise(a)
        return F.zip_with(under, over, wins)

    letters = F.concat(F.array_repeat(F.lit(None).cast("string"), F.get("w", F.lit(0))["sx"]), F.split(F.get("w", F.lit(0))["text"], ""))
    return writers.select("doc_id", "page", "y", F.aggregate(F.slice("w", F.lit(2), F.size("w")), letters, lay).alias("cells"))


def priority_paint(segments: DataFrame, width: int = 200, height: int = 100) -> DataFrame:
    """(doc_id, page, y, x, ch): a segment's characters go into its row of 6 by 12 cells, over blanks, or over anything if it is tall."""
    return _painted_rows(segments, width, height).select("doc_id", "page", "y", F.posexplode("cells").alias("x", "ch")).where("ch is not null")


def priority_rows(segments: DataFrame, width: int = 200, height: int = 100) -> DataFrame:
    """The rows of priority_paint's cells, as cell_rows gives them, without a row for each cell."""
    rows = _painted_rows(segments, width, height)
    written = F.filter("cells", lambda c: c.isNotNull())
    first = F.array_position(F.transform("cells", lambda c: c.isNotNull()), True) - 1
    return rows.select("doc_id", "page", "y", F.size(written).alias("n"), first.alias("first_x"), (F.size("cells") - 1).alias("last_x"), F.array_join(written, "").alias("text"))
