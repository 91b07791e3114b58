"""Queries over cursors, status lines, saved grids, fallbacks and page ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cursor, edit, geometry, grid
from ..sources import readers, views
from .base import GLYPHS, GRID, LINES, MARKS, by_document, documents, register, segments_sql


_FIRST = "count(*) AS n, min(x0) AS first_x0, max(x1) AS last_x1, max(y1) AS last_y1"


@register("page_glyphs", "doc_id:l n:l first_x0:d last_x1:d last_y1:d", f"WITH {LINES}, {segments_sql()}, {GLYPHS} @@ SELECT doc_id, {_FIRST} FROM glyphs WHERE page = 0 GROUP BY 1")
def page_glyphs(spark, sf_dir):
    """The first page's glyphs, summed up."""
    g = geometry.glyphs(geometry.on_page(views.segments(by_document(spark, sf_dir)), 0))
    return g.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("x0").alias("first_x0"), F.max("x1").alias("last_x1"), F.max("y1").alias("last_y1"))


@register("overprinted_glyphs", "doc_id:l n:l first_x0:d last_x1:d last_y1:d", f"WITH {LINES}, {segments_sql()}, {GLYPHS.replace('y + h * 8e-1 AS y1', 'y + h AS y1')} @@ SELECT doc_id, {_FIRST} FROM glyphs GROUP BY 1")
def overprinted_glyphs(spark, sf_dir):
    """All pages' glyphs in one coordinate space, summed up."""
    g = geometry.glyphs(geometry.overprinted(views.segments(by_document(spark, sf_dir))), full_height=True)
    return g.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("x0").alias("first_x0"), F.max("x1").alias("last_x1"), F.max("y1").alias("last_y1"))


_CURSOR = f"""WITH {LINES}, placed AS (SELECT doc_id, r, length(text) AS size, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  CASE WHEN lead(r) OVER (PARTITION BY doc_id ORDER BY r) IS NULL THEN greatest(length(text) - 1, 0) ELSE length(text) END AS reach FROM lines),
around AS (SELECT *, lag(start) OVER w AS above_start, lag(reach) OVER w AS above_reach, lead(start) OVER w AS below_start, lead(reach) OVER w AS below_reach FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY r)),
here AS (SELECT a.*, position, n_chars, position - start AS col FROM around AS a JOIN (SELECT doc_id, n_chars, (doc_id * 37) % (n_chars + 1) AS position FROM documents) AS d ON a.doc_id = d.doc_id
  WHERE start <= position AND position <= start + size)"""


def _cursors(spark, sf_dir):
    docs = by_document(spark, sf_dir)
    position = (F.col("doc_id") * 37) % (F.col("n_chars") + 1)
    return cursor.at_line(views.lines(docs), docs.select("doc_id", position.alias("position"), "n_chars"))


@register(
    "cursor_moves", "doc_id:l position:l up:l down:l left:l right:l",
    _CURSOR + """ @@ SELECT doc_id, position, coalesce(above_start + least(col, above_reach), position) AS "up", coalesce(below_start + least(col, below_reach), position) AS "down",
      greatest(position - 1, 0) AS "left", least(position + 1, n_chars) AS "right" FROM here""",
)
def cursor_moves(spark, sf_dir):
    """Where the arrow keys move a cursor in each document."""
    return cursor.moved(_cursors(spark, sf_dir), F.col("n_chars"))


@register("cursor_line_ends", "doc_id:l position:l home:l end:l", _CURSOR + ' @@ SELECT doc_id, position, start AS home, start + reach AS "end" FROM here')
def cursor_line_ends(spark, sf_dir):
    """Where Home and End move a cursor in each document."""
    return cursor.line_ends(_cursors(spark, sf_dir))


@register("cursor_status", "doc_id:l line:s", _CURSOR + " @@ SELECT doc_id, printf('Line %d, Col %d ', r + 1, col + 1) || CASE WHEN doc_id % 2 = 0 THEN printf('| SEL: %d chars ', doc_id % 40) ELSE '' END AS line FROM here")
def cursor_status(spark, sf_dir):
    """The status line of a cursor in each document."""
    selected = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 40)
    return _cursors(spark, sf_dir).select("doc_id", cursor.editor_status(F.col("line_idx"), F.col("col"), selected).alias("line"))


@register("grid_status", "doc_id:l line:s", f"WITH {GRID} @@ SELECT doc_id, printf('SPATIAL: %dx%d grid, %d chars', CAST(width AS BIGINT), CAST(height AS BIGINT), CAST(sum(length(replace(text, ' ', ''))) AS BIGINT)) AS line FROM grid_rows GROUP BY doc_id, width, height")
def grid_status(spark, sf_dir):
    """Size and filled cells of each grid, as text."""
    grids = grid.text_grid(documents(spark, sf_dir))
    return grids.select("doc_id", grid.filled().alias("n"), "width", "height").select("doc_id", cursor.grid_status(F.col("width"), F.col("height"), F.col("n")).alias("line"))


@register("page_status", "doc_id:l line:s", f"WITH {GRID} @@ SELECT doc_id, printf('Character Matrix (%dx%d) - Page %d | Text Regions: %d | Objects: %d', CAST(width AS BIGINT), CAST(height AS BIGINT), 1, 0, len(l)) AS line FROM grid")
def page_status(spark, sf_dir):
    """Statistics of each document's first page, as text."""
    grids = grid.text_grid(documents(spark, sf_dir), keep=("text",))
    objects = F.size(T.text_lines(F.col("text")))
    return grids.select("doc_id", cursor.page_status(F.col("width"), F.col("height"), F.lit(0), F.lit(0), objects).alias("line"))


@register("default_page_range", "doc_id:l page_range:s", "SELECT doc_id, CASE WHEN n_chars // 100 > 20 THEN '1-10' ELSE '' END AS page_range FROM documents")
def default_page_range(spark, sf_dir):
    """The page range that a file of so many pages starts with."""
    return documents(spark, sf_dir).select("doc_id", cursor.default_range(F.expr("n_chars div 100")).alias("page_range"))


@register("saved_grid", "doc_id:l text:s", f"WITH {GRID} @@ SELECT doc_id, string_agg(text, chr(10) ORDER BY row_idx) AS text FROM grid_rows GROUP BY 1")
def saved_grid(spark, sf_dir):
    """Each grid as its file's text."""
    return grid.saved_text(grid.text_grid(documents(spark, sf_dir)))


@register("exported_grid", "doc_id:l text:s", f"WITH {GRID} @@ SELECT doc_id, string_agg(printf('%4d ', row_idx + 1) || text, chr(10) ORDER BY row_idx) AS text FROM grid_rows GROUP BY 1")
def exported_grid(spark, sf_dir):
    """Each grid as its file's text, with line numbers."""
    return grid.saved_text(grid.text_grid(documents(spark, sf_dir)), numbers=True)


@register(
    "padded_lines", "doc_id:l row_idx:l text:s",
    f"""WITH {GRID}, stripped AS (SELECT doc_id, list_transform(l, lambda x: CASE WHEN instr(x, ' ') > 0 THEN substring(x, instr(x, ' ') + 1) ELSE x END) AS l FROM split),
    wide AS (SELECT doc_id, l, list_max(list_transform(l, lambda x: length(x))) AS w FROM stripped) @@
    SELECT doc_id, row_idx, rpad(t, CAST(w AS INTEGER), ' ') AS text FROM (SELECT doc_id, w, unnest(range(len(l))) AS row_idx, unnest(l) AS t FROM wide) AS q""",
)
def padded_lines(spark, sf_dir):
    """Lines after their first space, padded to the longest."""
    return grid.padded_lines(documents(spark, sf_dir))


@register(
    "typed_rows", "doc_id:l row_idx:l text:s",
    f"""WITH {GRID} @@ SELECT doc_id, row_idx, CASE WHEN row_idx = doc_id % 6 THEN rpad(left(text, CAST((doc_id * 7) % 120 AS INTEGER)), CAST((doc_id * 7) % 120 AS INTEGER), ' ')
      || CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'Z' END || substring(text, CAST((doc_id * 7) % 120 AS INTEGER) + 2) ELSE text END AS text FROM grid_rows""",
)
def typed_rows(spark, sf_dir):
    """Rows after a typed letter, or a Backspace, which writes a space."""
    d = F.col("doc_id")
    grids = grid.text_grid(documents(spark, sf_dir))
    return edit.pasted_grids(grids, F.array(F.when(d % 4 == 0, " ").otherwise("Z")), d % 6, (d * 7) % 120, F.col("width"))


@register(
    "extract_fallback", "doc_id:l text:s",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND regexp_matches(text, '[^\\s]') THEN text ELSE source END AS text FROM documents WHERE regexp_matches(text, '[^\\s]') OR regexp_matches(source, '[^\\s]')",
)
def extract_fallback(spark, sf_dir):
    """The first extract with any text: one that fails for most documents, then another."""
    docs = documents(spark, sf_dir)
    return grid.first_of(docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("").alias("text")), docs.select("doc_id", F.col("source").alias("text")))


@register(
    "clipboard_targets", "doc_id:l target:s",
    f"WITH {GRID}, {MARKS} @@ SELECT doc_id, CASE WHEN area > 100000 THEN 'none' WHEN area < 10000 THEN 'both' ELSE 'internal' END AS target FROM marks",
)
def clipboard_targets(spark, sf_dir):
    """Where a copied selection of each document goes, by its number of cells."""
    grids = grid.text_grid(documents(spark, sf_dir))
    d = F.col("doc_id")
    marks = edit.marked(grids.withColumns({"r0": d % 7, "c0": (d * 3) % 40, "r1": (d * 5) % 12, "c1": F.when(d % 50 == 0, 60000).otherwise((d * 7) % 90)}))
    return marks.select("doc_id", F.when(F.col("area") > edit.MOST_CELLS, "none").when(F.col("area") < 10_000, "both").otherwise("internal").alias("target"))


@register("cache_pages", "page_id:l last_turn:l", "SELECT conv_id AS page_id, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def cache_pages(spark, sf_dir):
    """The 20 keys used last, by another table's order."""
    return edit.latest(views.table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 20).withColumnsRenamed({"conv_id": "page_id", "turn": "last_turn"})
