"""Queries over lines, glyphs, cells and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import confidence_bucket
from ..operators import cells, edit, geometry, grid, grouping
from ..sources import readers, views
from .base import CELLS, ELEMENTS, GLYPHS, GRID, LINES, MAP, READING, SIZES, STARTS, WORDS, by_document, documents, register, segments_sql


_READ = f"WITH RECURSIVE {LINES}, {WORDS}, {ELEMENTS}, {STARTS}, {READING} @@ "
_GLYPHS = f"WITH {LINES}, {segments_sql()}, {GLYPHS}"
_CELLS = f"{_GLYPHS}, {SIZES}, {CELLS}"


@register("line_reconstruct", "doc_id:l line_idx:l text:s start_char:l end_char:l", _READ + "SELECT *, start_char + length(text) AS end_char FROM reading")
def line_reconstruct(spark, sf_dir):
    """Reading lines of positioned words, with their character range in the document."""
    return grouping.reading_lines(views.elements(by_document(spark, sf_dir)), together=True)


@register(
    "spatial_map", "doc_id:l line_idx:l elem_idx:l start_char:l end_char:l hpos:d vpos:d",
    f"WITH RECURSIVE {LINES}, {WORDS}, {ELEMENTS}, {STARTS}, {MAP} @@ SELECT * FROM spatial",
)
def spatial_map(spark, sf_dir):
    """Character ranges of words in reading order."""
    return grouping.spatial_map(views.elements(by_document(spark, sf_dir)), together=True)


@register("document_text", "doc_id:l text:s", _READ + "SELECT doc_id, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM reading GROUP BY doc_id")
def document_text(spark, sf_dir):
    """Each document's reconstructed text."""
    return grouping.document_text(grouping.reading_lines(views.elements(by_document(spark, sf_dir)), together=True))


@register(
    "alto_parse", "doc_id:l ord:l content:s hpos:d vpos:d width:d height:d",
    f"""WITH {LINES}, {WORDS}, {ELEMENTS} @@ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord,
      replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS content, hpos, vpos, width, height FROM elements""",
)
def alto_parse(spark, sf_dir):
    """Words read back from each document's ALTO XML."""
    return readers.alto_elements(views.alto_xml(by_document(spark, sf_dir)))


@register("text_grid_dims", "doc_id:l width:l height:l", f"WITH {GRID} @@ SELECT doc_id, width, height FROM grid")
def text_grid_dims(spark, sf_dir):
    """Grid sizes of texts."""
    return grid.text_grid(documents(spark, sf_dir))


@register("text_grid_rows", "doc_id:l row_idx:l text:s", f"WITH {GRID} @@ SELECT doc_id, row_idx, text FROM grid_rows")
def text_grid_rows(spark, sf_dir):
    """Padded rows of texts."""
    return grid.grid_rows(grid.text_grid(documents(spark, sf_dir)))


@register("nonblank_count", "doc_id:l n:l", f"WITH {GRID} @@ SELECT doc_id, sum(length(replace(text, ' ', ''))) AS n FROM grid_rows GROUP BY doc_id")
def nonblank_count(spark, sf_dir):
    """Filled cells of each grid."""
    return grid.filled_cells(grid.text_grid(documents(spark, sf_dir)))


@register(
    "glyph_geometry", "doc_id:l page:l seq:l n:l spaces:l first_x0:d last_x1:d sum_x0:d y0:d y1:d font_size:d",
    f"""{_GLYPHS} @@ SELECT doc_id, page, seq, count(*) AS n, count(*) FILTER (ch = ' ') AS spaces, min(x0) AS first_x0, max(x1) AS last_x1, sum(x0) AS sum_x0, min(y0) AS y0, max(y1) AS y1,
      min(font_size) AS font_size FROM glyphs GROUP BY 1, 2, 3""",
)
def glyph_geometry(spark, sf_dir):
    """Every segment's glyphs, summed up."""
    g = geometry.glyphs(views.segments(by_document(spark, sf_dir)))
    return g.groupBy("doc_id", "page", "seq").agg(
        F.count("*").alias("n"), F.count_if(F.col("ch") == " ").alias("spaces"), F.min("x0").alias("first_x0"), F.max("x1").alias("last_x1"), F.sum("x0").alias("sum_x0"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("font_size").alias("font_size"),
    )


@register("font_mode", "doc_id:l page:l mode:l", f"{_GLYPHS}, {SIZES} @@ SELECT doc_id, page, s AS mode FROM mode")
def font_mode(spark, sf_dir):
    """The commonest rounded font size of each page."""
    return geometry.font_mode(geometry.segment_sizes(views.segments(by_document(spark, sf_dir))))


@register(
    "font_upper_median", "doc_id:l page:l median:d char_w:d char_h:d",
    f"""{_GLYPHS}, sorted AS (SELECT doc_id, page, list(font_size ORDER BY font_size) AS l FROM glyphs WHERE font_size > 0 GROUP BY 1, 2) @@
      SELECT doc_id, page, l[len(l) // 2 + 1] AS median, greatest(l[len(l) // 2 + 1] * 6e-1, 4e0) AS char_w, greatest(l[len(l) // 2 + 1] * 12e-1, 8e0) AS char_h FROM sorted""",
)
def font_upper_median(spark, sf_dir):
    """The upper median font size of each page, and the character measures from it."""
    return geometry.upper_median(geometry.segment_sizes(views.segments(by_document(spark, sf_dir))))


@register("grid_size", "doc_id:l page:l width:l height:l char_w:d char_h:d", f"{_GLYPHS}, {SIZES} @@ SELECT * FROM sizes")
def grid_size(spark, sf_dir):
    """The grid that each page's glyphs need."""
    return geometry.grid_size(views.segments(by_document(spark, sf_dir)))


def _placed(spark, sf_dir, pitch=7.0):
    segments = views.segments(by_document(spark, sf_dir), pitch)
    return cells.placed(segments, geometry.grid_size(segments))


def _merged(spark, sf_dir):
    return grouping.merge_pieces(cells.pieces(_placed(spark, sf_dir, 14.0)))


_ROWS = "SELECT doc_id, page, y, count(*) AS n, min(x) AS first_x, max(x) AS last_x, string_agg(ch, '' ORDER BY x) AS text FROM {0} GROUP BY 1, 2, 3"


@register(
    "cells_last_writer", "doc_id:l page:l y:l n:l first_x:l last_x:l text:s",
    f"{_CELLS}, won AS (SELECT doc_id, page, y, x, arg_max(ch, region_id) AS ch FROM cells GROUP BY 1, 2, 3, 4) @@ " + _ROWS.format("won"),
)
def cells_last_writer(spark, sf_dir):
    """Glyphs in cells by rounding, the last writer of a cell winning."""
    return cells.last_writer_rows(_placed(spark, sf_dir))


@register(
    "cells_priority_paint", "doc_id:l page:l y:l n:l first_x:l last_x:l text:s",
    f"""WITH {LINES}, {segments_sql()}, corner AS (SELECT doc_id, page, min(x) AS mx, min(y) AS my FROM segments GROUP BY 1, 2),
    writes AS (SELECT doc_id, page, seq, tall, y, sx + i AS x, ch FROM (
      SELECT s.doc_id, s.page, seq, h > 14 AS tall, CAST(floor((y - my) / 12) AS INTEGER) AS y, CAST(floor((x - mx) / 6) AS INTEGER) AS sx, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch
      FROM segments AS s JOIN corner AS c ON s.doc_id = c.doc_id AND s.page = c.page) AS q WHERE sx + i < 200 AND y < 100),
    high AS (SELECT doc_id, page, y, x, max(seq) FILTER (tall) AS hs, arg_max(ch, seq) FILTER (tall) AS hc FROM writes GROUP BY 1, 2, 3, 4),
    won AS (SELECT w.doc_id, w.page, w.y, w.x, CASE WHEN any_value(hc) <> ' ' THEN any_value(hc) ELSE coalesce(arg_min(ch, seq) FILTER (ch <> ' ' AND (hs IS NULL OR seq > hs)), ' ') END AS ch
      FROM writes AS w JOIN high AS h ON w.doc_id = h.doc_id AND w.page = h.page AND w.y = h.y AND w.x = h.x GROUP BY 1, 2, 3, 4) @@ """ + _ROWS.format("won"),
)
def cells_priority_paint(spark, sf_dir):
    """Segments painted into cells, tall ones over what is there."""
    return grid.priority_rows(views.segments(by_document(spark, sf_dir)))


_CLEAN = f"WITH {LINES}, {segments_sql('14e0')}, {GLYPHS}, {SIZES}, {CELLS}"
_ISLANDS = """, reach AS (SELECT *, max(x + 1) OVER (PARTITION BY doc_id, page, y ORDER BY x, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM cells),
island AS (SELECT *, sum(CASE WHEN e IS NULL OR x - e > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, y ORDER BY x, region_id ROWS UNBOUNDED PRECEDING) AS g FROM reach),
regions AS (SELECT doc_id, page, y, min(x) AS x, max(x) + 1 - min(x) AS width, min(region_id) AS region_id, string_agg(ch, '' ORDER BY region_id) AS text FROM island GROUP BY doc_id, page, y, g)"""


@register("merge_regions", "doc_id:l page:l y:l x:l width:l region_id:l text:s", f"{_CLEAN}{_ISLANDS} @@ SELECT * FROM regions")
def merge_regions(spark, sf_dir):
    """Adjacent cells merged, one line to a row of the grid."""
    return _merged(spark, sf_dir)


_APART = f"WITH {LINES}, {segments_sql('20e0')}, {GLYPHS}, {SIZES}, {CELLS}"


@register("merge_regions_auto", "doc_id:l page:l y:l x:l width:l region_id:l text:s", f"{_APART}{_ISLANDS} @@ SELECT * FROM regions")
def merge_regions_auto(spark, sf_dir):
    """Lines so far apart that no two meet in a row of cells, each row's way of merging chosen by the order in which its cells arrive."""
    return cells.exact_regions(_placed(spark, sf_dir, 20.0))


@register("merge_regions_exact", "doc_id:l page:l y:l x:l width:l region_id:l text:s", None)
def merge_regions_exact(spark, sf_dir):
    """Adjacent cells merged in arrival order, several lines to a row of the grid."""
    return cells.exact_regions(_placed(spark, sf_dir, 7.0))


_CONFIDENCE = "((region_id * 7 + doc_id) % 11) / 10e0"


def scored_regions(spark, sf_dir):
    return _merged(spark, sf_dir).withColumn("confidence", F.pmod(F.col("region_id") * 7 + F.col("doc_id"), F.lit(11)) / F.lit(10.0))


@register(
    "region_buckets", "doc_id:l bucket:s n:l",
    f"""{_CLEAN}{_ISLANDS} @@ SELECT doc_id, CASE WHEN c > 8e-1 THEN 'high' WHEN c > 5e-1 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n
      FROM (SELECT doc_id, {_CONFIDENCE} AS c FROM regions) AS q GROUP BY 1, 2""",
)
def region_buckets(spark, sf_dir):
    """Regions by confidence."""
    return scored_regions(spark, sf_dir).groupBy("doc_id", confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@register(
    "region_viewport", "doc_id:l page:l region_id:l sx:d sy:d sw:d sh:d labelled:b",
    f"""{_CLEAN}{_ISLANDS} @@ SELECT *, sw > 20 AND sh > 15 AS labelled FROM (SELECT doc_id, page, region_id, x * 8e0 AS sx, y * 16e0 AS sy, width * 8e0 AS sw, 16e0 AS sh FROM regions) AS q
      WHERE sx <= 640 AND 80 <= sx + sw AND sy <= 480 AND 32 <= sy + sh""",
)
def region_viewport(spark, sf_dir):
    """Regions on screen: scaled, those that meet the viewport, and whether a label fits."""
    r = _merged(spark, sf_dir)
    s = r.select("doc_id", "page", "region_id", geometry.to_screen(F.col("x"), 8.0).alias("sx"), geometry.to_screen(F.col("y"), 16.0).alias("sy"), geometry.to_screen(F.col("width"), 8.0).alias("sw"), F.lit(16.0).alias("sh"))
    view = [F.lit(v) for v in (80.0, 32.0, 560.0, 448.0)]
    return s.where(geometry.meets(F.col("sx"), F.col("sy"), F.col("sw"), F.col("sh"), *view)).withColumn("labelled", (F.col("sw") > 20) & (F.col("sh") > 15))


@register(
    "bbox_contains", "doc_id:l n_inside:l n_all:l",
    f"""WITH {GRID}, boxes AS (SELECT doc_id, doc_id % 30 AS bx, doc_id % 9 AS b_y, 20 + doc_id % 11 AS bw, 3 + doc_id % 5 AS bh FROM documents) @@
      SELECT g.doc_id, sum(CASE WHEN row_idx >= b_y AND row_idx < b_y + bh THEN greatest(0, least(length(text), bx + bw) - bx) ELSE 0 END) AS n_inside, sum(length(text)) AS n_all
      FROM grid_rows AS g JOIN boxes AS b ON g.doc_id = b.doc_id GROUP BY g.doc_id""",
)
def bbox_contains(spark, sf_dir):
    """Cells inside a box of each document: rows are tested, columns counted as a range."""
    rows = grid.grid_rows(grid.text_grid(by_document(spark, sf_dir)))
    d = F.col("doc_id")
    bx, by, bw, bh = d % 30, d % 9, F.lit(20) + d % 11, F.lit(3) + d % 5
    inside = F.when(geometry.contains(bx, F.col("row_idx"), bx, by, bw, bh), F.greatest(F.lit(0), F.least(F.length("text"), bx + bw) - bx)).otherwise(0)
    return rows.groupBy("doc_id").agg(F.sum(inside).alias("n_inside"), F.sum(F.length("text")).alias("n_all"))


@register("bbox_area", "doc_id:l page:l area:l", f"{_CLEAN}{_ISLANDS} @@ SELECT doc_id, page, sum(width * 1) AS area FROM regions GROUP BY 1, 2")
def bbox_area(spark, sf_dir):
    """Area of each page's regions, in cells."""
    return _merged(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.col("width") * F.lit(1)).alias("area"))


_CLICKS = """clicks AS (SELECT doc_id * 3 + k AS click_id, doc_id, (doc_id * 5 + k * 7) % 40 AS "row", (doc_id * 11 + k * 13) % 120 AS col FROM documents, (SELECT unnest(range(3)) AS k) AS q)"""


@register(
    "nearest_line", "click_id:l doc_id:l line_idx:l position:l",
    f"""WITH RECURSIVE {LINES}, {WORDS}, {ELEMENTS}, {STARTS}, {READING}, {_CLICKS},
    ranked AS (SELECT click_id, c.doc_id, line_idx, start_char, length(text) AS letters, first_hpos, col, max(line_idx) OVER (PARTITION BY c.doc_id) AS last,
      row_number() OVER (PARTITION BY click_id ORDER BY abs("row" - greatest(CAST(floor(first_vpos / 12) AS INTEGER), 1)), line_idx) AS k FROM reading AS r JOIN clicks AS c ON r.doc_id = c.doc_id) @@
    SELECT click_id, doc_id, line_idx, start_char + least(greatest(col - greatest(CAST(floor(first_hpos / 8) AS INTEGER), 1), 0), letters - CASE WHEN line_idx = last THEN least(1, letters) ELSE 0 END) AS position
    FROM ranked WHERE k = 1""",
)
def nearest_line(spark, sf_dir):
    """Where clicks in a document land in its reconstructed text."""
    docs = by_document(spark, sf_dir)
    k, d = F.col("k"), F.col("doc_id")
    clicks = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    clicks = clicks.select((d * 3 + k).alias("click_id"), "doc_id", ((d * 5 + k * 7) % 40).alias("row"), ((d * 11 + k * 13) % 120).alias("col"))
    return grouping.nearest_line(grouping.reading_lines(views.elements(docs), together=True), clicks)


@register(
    "selection_overlap", "doc_id:l line_idx:l elem_idx:l start_char:l end_char:l",
    f"""WITH RECURSIVE {LINES}, {WORDS}, {ELEMENTS}, {STARTS}, {MAP} @@ SELECT * FROM spatial WHERE (doc_id * 17) % 300 < end_char AND (doc_id * 17) % 300 + 40 > start_char""",
)
def selection_overlap(spark, sf_dir):
    """Words that a character range of their document touches."""
    docs = by_document(spark, sf_dir)
    start = (F.col("doc_id") * 17) % 300
    return grouping.overlapping(grouping.spatial_map(views.elements(docs), together=True), docs.select("doc_id", start.alias("sel_start"), (start + 40).alias("sel_end")), together=True)


_THREE = "(SELECT unnest(range(3)) AS k) AS q"


def _three(docs):
    """Each document three times, with k from 0 to 2."""
    return docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))


@register(
    "selections_overlap", "sel_id:l doc_id:l line_idx:l elem_idx:l",
    f"""WITH RECURSIVE {LINES}, {WORDS}, {ELEMENTS}, {STARTS}, {MAP}, marks AS (SELECT doc_id * 3 + k AS sel_id, doc_id, (doc_id * 17 + k * 1009) % 6000 AS a, (doc_id * 17 + k * 1009) % 6000 + doc_id % 40 * (k + 1) AS b FROM documents, {_THREE}) @@
      SELECT sel_id, s.doc_id, line_idx, elem_idx FROM spatial AS s JOIN marks AS m ON s.doc_id = m.doc_id AND a < end_char AND b > start_char""",
)
def selections_overlap(spark, sf_dir):
    """Words that each of several character ranges of their document touches, some of these empty."""
    docs, d, k = by_document(spark, sf_dir), F.col("doc_id"), F.col("k")
    start = (d * 17 + k * 1009) % 6000
    marks = _three(docs).select((d * 3 + k).alias("sel_id"), "doc_id", start.alias("sel_start"), (start + d % 40 * (k + 1)).alias("sel_end"))
    return grouping.overlapping(grouping.spatial_map(views.elements(docs), together=True), marks, together=True)


@register(
    "word_viewports", "view_id:l doc_id:l ord:l",
    f"""WITH {LINES}, {WORDS}, {ELEMENTS}, screens AS (SELECT doc_id * 3 + k AS view_id, doc_id, 200e0 * k AS vx, 60e0 * k + doc_id % 50 AS vy, 90e0 + doc_id % 300 AS vw, 240e0 AS vh FROM documents, {_THREE}) @@
      SELECT view_id, e.doc_id, ord FROM elements AS e JOIN screens AS v ON e.doc_id = v.doc_id AND hpos <= vx + vw AND vx <= hpos + width AND vpos <= vy + vh AND vy <= vpos + height""",
)
def word_viewports(spark, sf_dir):
    """Words in each of several viewports of their document."""
    docs, d, k = by_document(spark, sf_dir), F.col("doc_id"), F.col("k")
    screens = _three(docs).select((d * 3 + k).alias("view_id"), "doc_id", (k * F.lit(200.0)).alias("vx"), (k * F.lit(60.0) + d % 50).alias("vy"), (F.lit(90.0) + d % 300).alias("vw"), F.lit(240.0).alias("vh"))
    boxes = views.elements(docs).select("doc_id", "ord", F.col("hpos").alias("x"), F.col("vpos").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return geometry.in_views(boxes, screens, together=True)


@register(
    "select_rects", "sel_id:l doc_id:l row_off:l text:s",
    f"""WITH {LINES}, marks AS (SELECT doc_id * 3 + k AS sel_id, doc_id, (doc_id + k * 5) % 30 AS r0, (doc_id * 3) % 20 AS r1, k * 11 AS c0, doc_id % 60 AS c1 FROM documents, {_THREE}) @@
      SELECT sel_id, l.doc_id, r - least(r0, r1) AS row_off, rpad(substr(text, CAST(least(c0, c1) + 1 AS INTEGER), CAST(abs(c1 - c0) + 1 AS INTEGER)), CAST(abs(c1 - c0) + 1 AS INTEGER), ' ') AS text
      FROM lines AS l JOIN marks AS m ON l.doc_id = m.doc_id AND r BETWEEN least(r0, r1) AND greatest(r0, r1)""",
)
def select_rects(spark, sf_dir):
    """What each of several rectangles of a document selects, filled up with spaces."""
    docs, d, k = by_document(spark, sf_dir), F.col("doc_id"), F.col("k")
    marks = _three(docs).select((d * 3 + k).alias("sel_id"), "doc_id", ((d + k * 5) % 30).alias("r0"), ((d * 3) % 20).alias("r1"), (k * 11).alias("c0"), (d % 60).alias("c1"))
    return edit.many_selected(views.lines(docs).withColumnRenamed("r", "row_idx"), marks)
