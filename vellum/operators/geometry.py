"""Glyphs from text segments, and the measures of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import Axis, overlap_join

from ..functions.text import with_starts

DEFAULT_ADVANCE, FONT_SHARE = 7.2, 0.8


def glyphs(segments: DataFrame, full_height: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, seq, i, ch, x0, y0, x1, y1, font_size): one row a character; as tall as its font, or as its segment.  ``keep``: further columns of the segments.

    A letter advances by its segment's mean width, a space by half of it.  The spaces
    before a character are the number of its word, so no running sum is needed.
    """
    advance = F.when(F.length("text") > 0, F.col("w") / F.length("text")).otherwise(DEFAULT_ADVANCE)
    pieces = with_starts(segments.withColumn("p", F.split("text", " ", -1)).withColumn("a", advance), "p", "at")
    zipped = F.arrays_zip(F.col("p").alias("word"), F.col("at").alias("off"))
    each = pieces.select("doc_id", "page", "seq", "x", "y", "h", "a", *keep, F.size("p").alias("n"), F.posexplode(zipped).alias("j", "z"))
    # a word's letters, and the space after it
    letters = F.split(F.when(F.col("j") < F.col("n") - 1, F.concat("z.word", F.lit(" "))).otherwise(F.col("z.word")), "")
    chars = each.select("doc_id", "page", "seq", "x", "y", "h", "a", *keep, "j", F.col("z.off").alias("off"), F.posexplode(letters).alias("k", "ch")).where("ch <> ''")
    i = F.col("off") + F.col("k")
    x0 = F.col("x") + F.col("a") * (i - F.lit(0.5) * F.col("j"))
    font = F.col("h") * FONT_SHARE
    step = F.when(F.col("ch") == " ", F.col("a") * 0.5).otherwise(F.col("a"))
    return chars.select("doc_id", "page", "seq", i.alias("i"), "ch", x0.alias("x0"), F.col("y").alias("y0"), (x0 + step).alias("x1"), (F.col("y") + (F.col("h") if full_height else font)).alias("y1"), font.alias("font_size"), *keep)


def on_page(segments: DataFrame, page: int) -> DataFrame:
    """A page's segments; the filter reaches the scan where ``page`` is a column of it."""
    return segments.where(F.col("page") == page)


def overprinted(segments: DataFrame) -> DataFrame:
    """All pages in one coordinate space, one over the other, page by page."""
    return segments.withColumn("page", F.lit(0))


def flipped(y_top: Column, page_height: float) -> Column:
    """From the page's foot to its head."""
    return F.lit(page_height) - y_top


def size_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, page, size, n): characters of each font size, which is all that the measures below need of them."""
    return rows.groupBy("doc_id", "page", F.col("font_size").alias("size")).agg(F.count("*").alias("n"))


def font_mode(counts: DataFrame) -> DataFrame:
    """(doc_id, page, mode): the commonest rounded size, the smallest of equals."""
    rounded = counts.groupBy("doc_id", "page", F.round("size").cast("int").alias("s")).agg(F.sum("n").alias("n"))
    return rounded.groupBy("doc_id", "page").agg(F.min(F.struct((-F.col("n")).alias("n"), "s")).alias("m")).select("doc_id", "page", F.col("m.s").alias("mode"))


def upper_median(counts: DataFrame) -> DataFrame:
    """(doc_id, page, median, char_w, char_h): the size at place n/2, from 0, of the sorted sizes above 0, and a character's measures."""
    page = Window.partitionBy("doc_id", "page")
    run = counts.where("size > 0").withColumn("upto", F.sum("n").over(page.orderBy("size"))).withColumn("all", F.sum("n").over(page))
    median = run.where(F.col("upto") > F.expr("all div 2")).groupBy("doc_id", "page").agg(F.min("size").alias("median"))
    return median.select("doc_id", "page", "median", F.greatest(F.col("median") * 0.6, F.lit(4.0)).alias("char_w"), F.greatest(F.col("median") * 1.2, F.lit(8.0)).alias("char_h"))


def page_extents(segments: DataFrame) -> DataFrame:
    """(doc_id, page, min_x, max_x, min_y, max_y, ...) of glyphs, from their segments: the last glyph ends a segment."""
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" ")))
    end = F.col("x") + F.col("w") / F.length("text") * (F.length("text") - F.lit(0.5) * spaces)
    return segments.groupBy("doc_id", "page").agg(F.min("x").alias("min_x"), F.max(end).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("h") * FONT_SHARE).alias("max_y"))


def segment_sizes(segments: DataFrame) -> DataFrame:
    """size_counts of the segments' glyphs, without making them."""
    return segments.groupBy("doc_id", "page", (F.col("h") * FONT_SHARE).alias("size")).agg(F.sum(F.length("text").cast("long")).alias("n"))


def grid_size(segments: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, char_w, char_h, min_x, min_y): the grid that holds a page's glyphs, 10 by 10 at least.

    A commonest size of 0 has no grid; it gets the cell of the default size 12.
    """
    mode = font_mode(segment_sizes(segments)).withColumn("m", F.when(F.col("mode") > 0, F.col("mode")).otherwise(12))
    sized = page_extents(segments).join(mode, ["doc_id", "page"]).withColumn("char_w", F.col("m") * F.lit(0.6)).withColumn("char_h", F.col("m") * F.lit(1.2))
    cells = lambda low, high, c: F.greatest(F.ceil((F.col(high) - F.col(low)) / F.col(c)), F.lit(10)).cast("int")
    return sized.select("doc_id", "page", cells("min_x", "max_x", "char_w").alias("width"), cells("min_y", "max_y", "char_h").alias("height"), "char_w", "char_h", "min_x", "min_y")


def contains(x: Column, y: Column, box_x: Column, box_y: Column, box_w: Column, box_h: Column) -> Column:
    """Half-open on the right and below."""
    return (x >= box_x) & (x < box_x + box_w) & (y >= box_y) & (y < box_y + box_h)


def to_screen(cells: Column, size: float, offset: float = 0.0) -> Column:
    return cells * F.lit(size) + F.lit(offset)


def meets(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Whether two rectangles meet."""
    return (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh) & (by <= ay + ah)


#: Points of one cell of in_views, each way.
TILE = 256.0


def in_views(boxes: DataFrame, views: DataFrame, together: bool = False) -> DataFrame:
    """Boxes (doc_id, x, y, w, h, ...) with each viewport (view_id, doc_id, vx, vy, vw, vh) of their document that they meet; of both there may be very many.  together: as for overlap_join."""
    ends = lambda at, size: (F.col(at), F.col(at) + F.col(size))
    return overlap_join(boxes, views, ["doc_id"], [Axis(*ends("x", "w"), *ends("vx", "vw"), TILE), Axis(*ends("y", "h"), *ends("vy", "vh"), TILE)], together)
