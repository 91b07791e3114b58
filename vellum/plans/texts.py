"""Queries over rows of text: search, selection, editing, reports; over events; and over the export tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, catalog, edit, grid, grouping, report, rope, search
from ..sources import readers, views
from .base import EXPORT, GRID, LINES, MARKS, WORDS, by_document, documents, register


def _rows(spark, sf_dir):
    return views.lines(documents(spark, sf_dir)).withColumnRenamed("r", "row_idx")


_HITS = f"""WITH {LINES}, pieces AS (SELECT doc_id, r AS row_idx, string_split(text, 'en') AS p FROM lines),
hits AS (SELECT doc_id, row_idx, k, list_sum(list_transform(p[1:k + 1], lambda x: length(x))) + k * 2 AS col_char, list_sum(list_transform(p[1:k + 1], lambda x: strlen(x))) + k * 2 AS col_byte
  FROM (SELECT *, unnest(range(len(p) - 1)) AS k FROM pieces) AS q)"""


@register("search_hits", "doc_id:l row_idx:l k:l col_char:l col_byte:l", _HITS + " @@ SELECT * FROM hits")
def search_hits(spark, sf_dir):
    """Places of 'en' in all lines."""
    return search.find(_rows(spark, sf_dir), "en")


@register(
    "search_next_prev", "doc_id:l hit:l row_idx:l col_char:l next_row:l next_col:l prev_row:l prev_col:l",
    _HITS + """, numbered AS (SELECT doc_id, row_idx, col_char, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx, col_char) - 1 AS hit, count(*) OVER (PARTITION BY doc_id) AS n FROM hits) @@
    SELECT a.doc_id, a.hit, a.row_idx, a.col_char, b.row_idx AS next_row, b.col_char AS next_col, c.row_idx AS prev_row, c.col_char AS prev_col FROM numbered AS a
    JOIN numbered AS b ON a.doc_id = b.doc_id AND b.hit = (a.hit + 1) % a.n JOIN numbered AS c ON a.doc_id = c.doc_id AND c.hit = (a.hit + a.n - 1) % a.n""",
)
def search_next_prev(spark, sf_dir):
    """Hits with the next and the previous one."""
    rows = views.lines(by_document(spark, sf_dir)).withColumnRenamed("r", "row_idx")
    return search.numbered_hits(search.find(rows, "en"))


@register(
    "search_highlight", "doc_id:l row_idx:l col_char:l",
    _HITS + f", {WORDS} @@ SELECT DISTINCT w.doc_id, w.r AS row_idx, w.off AS col_char FROM words AS w JOIN hits AS h ON w.doc_id = h.doc_id AND w.r = h.row_idx AND w.off = h.col_char WHERE content <> ''",
)
def search_highlight(spark, sf_dir):
    """Word starts at which a hit starts."""
    docs = by_document(spark, sf_dir)
    starts = views.words(docs).where("content <> ''").select("doc_id", F.col("r").alias("row_idx"), F.col("off").alias("col_char"))
    return search.highlighted(starts, search.find(views.lines(docs).withColumnRenamed("r", "row_idx"), "en"))


@register(
    "highlight_runs", "doc_id:l row_idx:l start:l end:l style:s",
    _HITS + """, chars AS (SELECT doc_id, r AS row_idx, unnest(range(length(text))) AS c FROM lines),
    styled AS (
      SELECT c.doc_id, c.row_idx, c.c, CASE WHEN c.row_idx BETWEEN least(c.doc_id % 7, c.doc_id % 4) AND greatest(c.doc_id % 7, c.doc_id % 4) AND c.c BETWEEN least(c.doc_id % 31, c.doc_id % 53) AND greatest(c.doc_id % 31, c.doc_id % 53) THEN 'selection'
        WHEN c.row_idx = c.doc_id % 3 AND c.c = c.doc_id % 40 THEN 'cursor' WHEN h.doc_id IS NOT NULL THEN 'hit' END AS style
      FROM chars AS c LEFT JOIN hits AS h ON h.doc_id = c.doc_id AND h.row_idx = c.row_idx AND c.c BETWEEN h.col_char AND h.col_char + 1),
    marked AS (SELECT *, c - row_number() OVER (PARTITION BY doc_id, row_idx, style ORDER BY c) AS g FROM styled WHERE style IS NOT NULL) @@
    SELECT doc_id, row_idx, min(c) AS start, max(c) + 1 AS "end", style FROM marked GROUP BY doc_id, row_idx, style, g""",
)
def highlight_runs(spark, sf_dir):
    """How rows are to be coloured: a selection over the cursor over hits of 'en', both letters of them."""
    rows, d = _rows(spark, sf_dir), F.col("doc_id")
    docs = documents(spark, sf_dir)
    marks = docs.select("doc_id", (d % 7).alias("r0"), (d % 31).alias("c0"), (d % 4).alias("r1"), (d % 53).alias("c1"))
    cursors = docs.select("doc_id", (d % 3).alias("row_idx"), (d % 40).alias("col"))
    return search.highlight_runs(rows, marks, cursors, search.find(rows, "en"), hit_length=2)


def _grid(spark, sf_dir):
    """Each document's grid with its normalised selection."""
    d = F.col("doc_id")
    corners = {"r0": d % 7, "c0": (d * 3) % 40, "r1": (d * 5) % 12, "c1": F.when(d % 50 == 0, 60000).otherwise((d * 7) % 90)}
    return edit.marked(grid.text_grid(documents(spark, sf_dir)).withColumns(corners))


_SELECTED = f"""WITH {GRID}, {MARKS},
hit AS (SELECT g.doc_id, row_idx - top AS row_off, area, "right" - "left" + 1 AS w, substring(text, CAST("left" AS INTEGER) + 1, CAST("right" - "left" + 1 AS INTEGER)) AS part
  FROM grid_rows AS g JOIN marks AS m ON g.doc_id = m.doc_id AND row_idx BETWEEN top AND bottom)"""
_COPIED = """ @@ SELECT doc_id, string_agg({0}, chr(10) ORDER BY row_off) AS text FROM hit WHERE area <= 100000 GROUP BY doc_id
  UNION ALL SELECT doc_id, '[Selection too large]' FROM marks WHERE area > 100000"""
_AT = """cut AS (SELECT g.doc_id, row_idx, width, height, CASE WHEN area <= 100000 AND row_idx BETWEEN top AND bottom AND length(text) > "left" THEN
    left(text, CAST("left" AS INTEGER)) || repeat(' ', CAST(least("right" + 1, length(text)) - "left" AS INTEGER)) || substring(text, CAST(least("right" + 1, length(text)) AS INTEGER) + 1) ELSE text END AS text
  FROM grid_rows AS g JOIN marks AS m ON g.doc_id = m.doc_id)"""


def _pasted_sql(base: str, row: str, col: str, clip: str = "hit") -> str:
    kept = f"left(part, CAST(greatest(0, length(text) - ({col})) AS INTEGER))"
    return f"""SELECT b.doc_id, row_idx, CASE WHEN part IS NULL OR length({kept}) = 0 THEN text ELSE left(text, CAST({col} AS INTEGER)) || {kept} || substring(text, CAST({col} + length({kept}) AS INTEGER) + 1) END AS text
      FROM {base} AS b LEFT JOIN {clip} AS h ON b.doc_id = h.doc_id AND row_idx = row_off + {row}"""


@register("select_rect_ragged", "doc_id:l text:s", _SELECTED + _COPIED.format("part"))
def select_rect_ragged(spark, sf_dir):
    """Each document's selection as text, short rows left short."""
    return edit.copied_grids(_grid(spark, sf_dir))


@register("select_rect_padded", "doc_id:l text:s", _SELECTED + _COPIED.format("rpad(part, CAST(w AS INTEGER), ' ')"))
def select_rect_padded(spark, sf_dir):
    """Each document's selection as text, short rows filled up."""
    return edit.copied_grids(_grid(spark, sf_dir), padded=True)


@register("cut_rect", "doc_id:l row_idx:l text:s", f"WITH {GRID}, {MARKS}, {_AT} @@ SELECT doc_id, row_idx, text FROM cut")
def cut_rect(spark, sf_dir):
    """Rows with the selection cut out."""
    return edit.cut_grids(_grid(spark, sf_dir))


_SMALL = "small AS (SELECT * FROM hit WHERE area <= 100000)"


@register("move_rect", "doc_id:l row_idx:l text:s", f"{_SELECTED}, {_AT}, {_SMALL} @@ " + _pasted_sql("cut", "(b.doc_id % 9)", "(b.doc_id % 25)", "small"))
def move_rect(spark, sf_dir):
    """Rows with the selection moved."""
    return edit.pasted_grids(_grid(spark, sf_dir), edit.clip(), F.col("doc_id") % 9, F.col("doc_id") % 25, cut=True)


@register("paste_clip", "doc_id:l row_idx:l text:s", f"{_SELECTED}, {_SMALL} @@ " + _pasted_sql("grid_rows", "(b.height - 2)", "(b.doc_id % 90)", "small"))
def paste_clip(spark, sf_dir):
    """Rows with the selection pasted near the foot, cut at the grid's edges."""
    return edit.pasted_grids(_grid(spark, sf_dir), edit.clip(), F.col("height") - 2, F.col("doc_id") % 90)


def _growing_sql(row: str, col: str, width: str, clip: str) -> str:
    """Rows and new rows below them, pieces written over."""
    return f"""every AS (SELECT doc_id, row_idx, text FROM grid_rows UNION ALL
      SELECT doc_id, unnest(range(height, reach + 1)) AS row_idx, repeat(' ', CAST({width} AS INTEGER)) AS text FROM (SELECT g.doc_id, width, height, max(row_off + {row}) AS reach FROM grid AS g JOIN {clip} AS c ON g.doc_id = c.doc_id GROUP BY 1, 2, 3) AS q),
    laid AS (SELECT g.doc_id, row_off + {row} AS row_idx, {col} AS spot, part FROM grid AS g JOIN {clip} AS c ON g.doc_id = c.doc_id) @@
    SELECT e.doc_id, e.row_idx, CASE WHEN part IS NULL OR part = '' THEN text ELSE rpad(left(text, CAST(spot AS INTEGER)), CAST(spot AS INTEGER), ' ') || part || substring(text, CAST(spot + length(part) AS INTEGER) + 1) END AS text
    FROM every AS e LEFT JOIN laid AS l ON e.doc_id = l.doc_id AND e.row_idx = l.row_idx"""


@register("paste_grow", "doc_id:l row_idx:l text:s", f"{_SELECTED}, {_SMALL}, " + _growing_sql("(g.height - 1)", "(g.doc_id % 90)", "width", "small"))
def paste_grow(spark, sf_dir):
    """Rows with the selection pasted at the foot, the grid growing."""
    grids = _grid(spark, sf_dir)
    # a selection that isn't copied adds no rows
    row = F.when(edit.fits(), F.col("height") - 1).otherwise(0)
    return edit.pasted_grids(grids, edit.clip(), row, F.col("doc_id") % 90, F.col("width"))


@register(
    "paste_rect_block", "doc_id:l row_idx:l text:s",
    f"""{_SELECTED}, {_SMALL}, indented AS (SELECT doc_id, row_off, '  ' || part AS t FROM small), least_in AS (SELECT doc_id, min(length(t) - length(ltrim(t, ' '))) AS i FROM indented GROUP BY 1),
    block AS (SELECT a.doc_id, row_off, substring(t, CAST(i AS INTEGER) + 1) AS part FROM indented AS a JOIN least_in AS b ON a.doc_id = b.doc_id), """
    + _growing_sql("(g.height - 2)", "3", "greatest(width, 80)", "block"),
)
def paste_rect_block(spark, sf_dir):
    """Rows with an indented block pasted at the foot, its common indent taken off, the grid growing."""
    grids = _grid(spark, sf_dir).withColumn("_indented", F.transform(edit.clip(), lambda x: F.concat(F.lit("  "), x)))
    clip = T.common_indent_removed(F.col("_indented"))
    row = F.when(edit.fits(), F.col("height") - 2).otherwise(0)
    return edit.pasted_grids(grids, clip, row, F.lit(3), F.greatest(F.col("width"), F.lit(80)))


_PASTED = r"""copied AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' || coalesce(lang, 'x') || 'abc' || chr(10) || '  ' || coalesce(lang, 'x') || 'defg' WHEN 2 THEN chr(9) || 'a' || chr(7) || chr(10) || 'bcdefgh' ELSE 'x' || chr(13) || 'yz' END AS t FROM documents),
clean AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(9), '    '), chr(13), chr(10)), '[\x00-\x09\x0B-\x1F\x7F-\x9F]', '', 'g') AS t FROM copied),
pieces AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split(t, chr(10)) END AS p FROM clean),
judged AS (SELECT doc_id, p, len(p) > 1 AND len(list_filter(p, lambda x: abs(strlen(x) - strlen(p[1])) > 2)) = 0 AND len(list_filter(p, lambda x: length(x) - length(ltrim(x, ' ')) <> length(p[1]) - length(ltrim(p[1], ' ')))) = 0 AS b,
  list_min(list_transform(p, lambda x: length(x) - length(ltrim(x, ' ')))) AS i FROM pieces),
ready AS (SELECT doc_id, CASE WHEN b THEN list_transform(p, lambda x: substring(x, CAST(i AS INTEGER) + 1)) WHEN len(p) = 0 THEN [' '] ELSE p END AS p FROM judged),
clip AS (SELECT doc_id, unnest(range(len(p))) AS row_off, unnest(p) AS part FROM ready)"""


@register("paste_text", "doc_id:l row_idx:l text:s", f"WITH {GRID}, {_PASTED}, " + _growing_sql("(g.height - 1)", "(g.doc_id % 90)", "greatest(width, 80)", "clip"))
def paste_text(spark, sf_dir):
    """Rows after another program's text is pasted at the foot: a block, plain lines, or nothing at all."""
    d, lang = F.col("doc_id"), F.coalesce("lang", F.lit("x"))
    block = F.concat(F.lit("  "), lang, F.lit("abc\n  "), lang, F.lit("defg"))
    text = F.when(d % 4 == 0, "").when(d % 4 == 1, block).when(d % 4 == 2, "\ta\x07\nbcdefgh").otherwise("x\ryz")
    return edit.pasted_text(grid.text_grid(documents(spark, sf_dir), keep=("lang",)), text, F.col("height") - 1, d % 90)


@register(
    "sanitize_text", "doc_id:l text:s",
    r"""SELECT doc_id, regexp_replace(replace(replace(translate(text, 'ano', chr(9) || chr(13) || chr(7)), chr(9), '    '), chr(13), chr(10)), '[\x00-\x09\x0B-\x1F\x7F-\x9F]', '', 'g') AS text FROM documents""",
)
def sanitize_text(spark, sf_dir):
    """Texts, some of whose letters are made control characters, sanitised."""
    return documents(spark, sf_dir).select("doc_id", T.sanitise(F.translate("text", "ano", "\t\r\x07")).alias("text"))


@register(
    "rect_block_test", "doc_id:l is_block:b",
    f"""WITH {GRID} @@ SELECT doc_id, len(l) > 1 AND len(list_filter(l, lambda x: abs(strlen(x) - strlen(l[1])) > 2)) = 0
      AND len(list_filter(l, lambda x: length(x) - length(ltrim(x, ' ')) <> length(l[1]) - length(ltrim(l[1], ' ')))) = 0 AS is_block FROM split""",
)
def rect_block_test(spark, sf_dir):
    """Whether a text is a rectangular block."""
    return documents(spark, sf_dir).select("doc_id", T.text_lines(F.col("text")).alias("l")).select("doc_id", T.is_block(F.col("l")).alias("is_block"))


@register("strip_first_token", "doc_id:l row_idx:l text:s", f"WITH {LINES} @@ SELECT doc_id, r AS row_idx, CASE WHEN instr(text, ' ') > 0 THEN substring(text, instr(text, ' ') + 1) ELSE text END AS text FROM lines")
def strip_first_token(spark, sf_dir):
    """Lines after their first space."""
    return _rows(spark, sf_dir).withColumn("text", T.strip_first_token(F.col("text")))


_NUMBERED = "numbered AS (SELECT doc_id, r AS row_idx, printf('%4d ', r + 1) || text AS text FROM lines)"


@register("number_lines", "doc_id:l row_idx:l text:s", f"WITH {LINES}, {_NUMBERED} @@ SELECT * FROM numbered")
def number_lines(spark, sf_dir):
    """Lines after their number."""
    return _rows(spark, sf_dir).withColumn("text", T.numbered(F.col("text"), F.col("row_idx") + 1))


@register("strip_line_number", "doc_id:l row_idx:l text:s", f"WITH {LINES} @@ SELECT doc_id, r AS row_idx, CASE WHEN r % 3 = 1 THEN regexp_replace(r || text, '^\\s*[0-9]+ ', '') ELSE text END AS text FROM lines")
def strip_line_number(spark, sf_dir):
    """Numbers taken off lines that have one: right-aligned ones, others after blanks, but none that no space follows."""
    r, text = F.col("row_idx"), F.col("text")
    numbered = F.when(r % 3 == 0, T.numbered(text, r + 1)).when(r % 3 == 2, F.concat(F.lit(" \t"), r.cast("string"), F.lit(" "), text)).otherwise(F.concat(r.cast("string"), text))
    return _rows(spark, sf_dir).select("doc_id", "row_idx", T.strip_line_number(numbered).alias("text"))


@register(
    "stext_parse", "doc_id:l row_idx:l col_idx:l ch:s",
    f"""WITH {LINES}, {WORDS} @@ SELECT doc_id, r AS row_idx, off % 200 AS col_idx, left(arg_max(content, j), 1) AS ch FROM words WHERE content <> '' AND r < 100 GROUP BY 1, 2, 3""",
)
def stext_parse(spark, sf_dir):
    """Cells of structured text made of each document's words."""
    lines = T.with_starts(views.lines(by_document(spark, sf_dir)).withColumn("p", F.split("text", " ", -1)), "p", "at")
    words = F.filter(F.arrays_zip(F.col("p").alias("content"), F.col("at").alias("off")), lambda w: w["content"] != "")
    x = lambda w: F.lpad(((w["off"] % 200) * 7).cast("string"), 4, "0")
    tag = lambda w: F.concat(F.lit('<char y="1" x="'), x(w), F.lit('">'), F.left(w["content"], F.lit(1)))
    line = F.array_join(F.array_append(F.transform(words, tag), F.lit("</line>")), "\n")
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda c: c["line"]), "\n").alias("text"))
    return readers.structured_text_cells(docs)


_OUTPUT = "output AS (SELECT doc_id, r AS row_idx, CASE WHEN r % 3 = 0 THEN '  ' || r || ' ' || text WHEN r % 3 = 1 THEN 'x' || r || text ELSE text END AS text FROM lines)"


@register("digit_lines", "doc_id:l row_idx:l text:s", f"WITH {LINES}, {_OUTPUT} @@ SELECT * FROM output WHERE ascii(ltrim(text, ' ' || chr(9) || chr(13))) BETWEEN 48 AND 57")
def digit_lines(spark, sf_dir):
    """Lines of a tool's output, some of them with a number, that start with a digit."""
    r, text = F.col("row_idx"), F.col("text")
    output = F.when(r % 3 == 0, F.concat(F.lit("  "), r.cast("string"), F.lit(" "), text)).when(r % 3 == 1, F.concat(F.lit("x"), r.cast("string"), text)).otherwise(text)
    return readers.lines_with_numbers(_rows(spark, sf_dir).withColumn("text", output))


@register("pages_line", "doc_id:l pages:l", "SELECT doc_id, n_chars AS pages FROM documents")
def pages_line(spark, sf_dir):
    """Page counts out of info texts."""
    info = F.concat(F.lit("Title: "), F.col("source"), F.lit("\nPages:   "), F.col("n_chars").cast("string"), F.lit("\nSize: 3"))
    return documents(spark, sf_dir).select("doc_id", T.page_count(info).alias("pages"))


def _reported(spark, sf_dir):
    """Grids with a region for each line that isn't blank, which are their objects too."""
    grids = grid.text_grid(documents(spark, sf_dir), keep=("text",))
    text = F.split("text", "\n", -1)
    lines = F.filter(F.transform(text, lambda x, i: F.struct(i.alias("y"), x.alias("text"))), lambda r: T.not_blank(r["text"]))
    region = lambda r, i: F.struct(i.alias("i"), F.lit(0).alias("x"), r["y"].alias("y"), F.length(r["text"]).alias("width"), F.lit(1).alias("height"), F.lit(1.0).alias("confidence"), r["text"].alias("text"))
    return grids.withColumn("regions", F.transform(lines, region)).withColumn("objects", F.size("regions"))


_REPORT = f"""WITH {LINES}, {GRID}, regions AS (SELECT doc_id, r AS y, text, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS i FROM lines WHERE regexp_matches(text, '[^\\s]')),
counted AS (SELECT g.*, coalesce(n, 0) AS n FROM grid AS g LEFT JOIN (SELECT doc_id, count(*) AS n FROM regions GROUP BY 1) AS c ON g.doc_id = c.doc_id)"""


@register(
    "matrix_report", "doc_id:l text:s",
    _REPORT + """, body AS (SELECT doc_id, string_agg(CASE WHEN height > 20 THEN printf('%3d ', row_idx) ELSE '' END || text, chr(10) ORDER BY row_idx) AS t FROM grid_rows GROUP BY 1),
    tail AS (SELECT doc_id, string_agg(printf('Region %d: (0,%d) %dx1 conf:1.00 - "%s"', i + 1, y, length(text), left(text, 50)), chr(10) ORDER BY i) AS t FROM regions GROUP BY 1) @@
    SELECT c.doc_id, printf('Character Matrix (%dx%d) | Char: 8.0x12.0pt:', width, height) || chr(10) || printf('Text Regions: %d | Original Text Objects: %d', n, n) || chr(10)
      || repeat('═', CAST(least(width, 80) AS INTEGER)) || chr(10) || body.t || chr(10) || repeat('═', CAST(least(width, 80) AS INTEGER)) || coalesce(chr(10) || tail.t, '') AS text
    FROM counted AS c JOIN body ON c.doc_id = body.doc_id LEFT JOIN tail ON c.doc_id = tail.doc_id""",
)
def matrix_report(spark, sf_dir):
    """Each document's grid and regions as a report."""
    return report.matrix_report(_reported(spark, sf_dir), 8.0, 12.0)


def _quoted(lines) -> str:
    return " || chr(10) || ".join("'" + x + "'" for x in lines)


# Characters of white space.
_BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SHOWN = f"""WITH {LINES}, {GRID}, regions AS (
  SELECT doc_id, r AS i, CASE r % 5 WHEN 1 THEN chr(9) || chr(160) || chr(8195) WHEN 3 THEN repeat('é', doc_id % 30) || '漢🙂' || text ELSE text END AS text FROM lines),
counted AS (SELECT g.*, coalesce(n, 0) AS n FROM grid AS g LEFT JOIN (SELECT doc_id, count(*) AS n FROM regions GROUP BY 1) AS c ON g.doc_id = c.doc_id)"""


@register(
    "console_report", "doc_id:l text:s",
    _SHOWN + f""", body AS (SELECT doc_id, string_agg(printf('%3d ', row_idx) || replace(text, ' ', '·'), chr(10) ORDER BY row_idx) AS t FROM grid_rows GROUP BY 1),
    tail AS (SELECT doc_id, string_agg(printf('✅ Found text region %d: "%s" (Confidence: 100.0%%)', i + 1,
        CASE WHEN strlen(text) > 50 THEN left(text, len(list_filter(range(1, 51), lambda k: strlen(left(text, k)) <= 50))) || '...' ELSE text END), chr(10) ORDER BY i) AS t
      FROM regions WHERE i < 5 AND regexp_matches(text, '[^{_BLANK}]') GROUP BY 1) @@
    SELECT c.doc_id, '{report.CONSOLE_HEAD}' || chr(10) || printf('Matrix Size: %d columns × %d rows', width, height) || chr(10) || printf('Regions Detected: %d', n) || chr(10) || printf('Text Objects: %d', n) || chr(10)
      || 'Processing Time: N/A' || chr(10) || '{report.TOGGLES}' || chr(10) || body.t || chr(10) || '{report.DONE_HEAD}' || chr(10) || coalesce(tail.t, {_quoted(report.DEFAULTS)}) || chr(10)
      || '{report.ISSUES_HEAD}' || chr(10) || {_quoted(report.ISSUES)} AS text
    FROM counted AS c JOIN body ON c.doc_id = body.doc_id LEFT JOIN tail ON c.doc_id = tail.doc_id""",
)
def console_report(spark, sf_dir):
    """Each document's grid and regions, one for each line, as a console report; some regions hold white space only, some many bytes a character."""
    shown = lambda x, i: F.when(i % 5 == 1, "\t\xa0\u2003").when(i % 5 == 3, F.concat(F.repeat(F.lit("é"), (F.col("doc_id") % 30).cast("int")), F.lit("漢🙂"), x)).otherwise(x)
    region = lambda x, i: F.struct(i.alias("i"), F.lit(0).alias("x"), i.alias("y"), F.length(x).alias("width"), F.lit(1).alias("height"), F.lit(1.0).alias("confidence"), shown(x, i).alias("text"))
    grids = grid.text_grid(documents(spark, sf_dir), keep=("text",))
    regions = grids.withColumn("regions", F.transform(F.split("text", "\n", -1), region))
    return report.console_report(regions.withColumn("objects", F.size("regions")))


def events(spark, sf_dir):
    return views.table(spark, sf_dir, "events")


@register(
    "dpi_bucket", "dpi:l n:l",
    """SELECT CASE WHEN c IS NULL THEN 96 WHEN c <= 80 THEN 72 WHEN c <= 120 THEN 96 WHEN c <= 200 THEN 120 ELSE 150 END AS dpi, count(*) AS n
      FROM (SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 260 END AS c FROM events) AS q GROUP BY 1""",
)
def dpi_bucket(spark, sf_dir):
    """Resolutions for the widths of terminals."""
    columns = F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 260)
    return events(spark, sf_dir).groupBy(T.dpi_for(columns).alias("dpi")).agg(F.count("*").alias("n"))


@register("lru_topk", "user_id:l event_id:l", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) AS q WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 20")
def lru_topk(spark, sf_dir):
    """The 20 users seen last, which a cache of 20 places would hold, and their last event."""
    return edit.latest(events(spark, sf_dir), "user_id", ["ts", "event_id"], 20)


@register("log_tail", "event_id:l event_type:s", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def log_tail(spark, sf_dir):
    """The last 100 events."""
    return events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


def _export(spark, sf_dir):
    return catalog.joined(*views.export_tables(views.table(spark, sf_dir, "pages")))


_ELEMENT = "element_id:l element_type:s element_text:s"


@register("bold_by_role_sql", _ELEMENT, f"WITH {EXPORT} @@ SELECT * FROM tables WHERE semantic_role = 'header' AND style_bold")
def bold_by_role_sql(spark, sf_dir):
    """Bold headers, by SQL over three tables."""
    names = dict(zip(("content", "styles", "semantics"), views.export_tables(views.table(spark, sf_dir, "pages"))))
    return spark.sql(
        """SELECT c.element_id, c.element_type, c.element_text FROM {content} AS c JOIN {styles} AS s ON c.content_id = s.element_id
        JOIN {semantics} AS m ON c.element_id = m.element_id WHERE m.semantic_role = 'header' AND s.style_bold""", **names
    )


@register("bold_financial", _ELEMENT, f"WITH {EXPORT} @@ SELECT * FROM tables WHERE semantic_role = 'financial_text' AND style_bold")
def bold_financial(spark, sf_dir):
    """Bold financial text."""
    return catalog.with_role(_export(spark, sf_dir), "financial_text")


@register(
    "headers_on_page", _ELEMENT + " exact:b",
    f"WITH {EXPORT} @@ SELECT *, page = 5 AS exact FROM tables WHERE element_type IN ('h1', 'h2', 'h3') AND contains(element_metadata, '\"page\": 5')",
)
def headers_on_page(spark, sf_dir):
    """Headers whose metadata mention page 5, and whether they are on it."""
    content = views.content(views.table(spark, sf_dir, "pages"))
    found = content.where(F.col("element_type").isin("h1", "h2", "h3") & catalog.mentions_page(F.col("element_metadata"), 5))
    return found.withColumn("exact", catalog.is_on_page(F.col("element_metadata"), 5))


@register("role_filter", "semantic_role:s element_text:s page:l", f"WITH {EXPORT} @@ SELECT semantic_role, element_text, page FROM tables WHERE semantic_role = 'financial_text'")
def role_filter(spark, sf_dir):
    """Financial text with its page."""
    found = catalog.with_role(_export(spark, sf_dir), "financial_text", bold=None)
    return found.select("semantic_role", "element_text", F.get_json_object("element_metadata", "$.page").alias("page"))


@register(
    "edit_replay_cells", "doc_id:l row_idx:l col_idx:l ch:s",
    "SELECT user_id AS doc_id, event_id % 10 AS row_idx, event_id % 37 AS col_idx, arg_max(CASE WHEN event_id % 5 = 0 THEN ' ' ELSE left(event_type, 1) END, event_id) AS ch FROM events GROUP BY 1, 2, 3",
)
def edit_replay_cells(spark, sf_dir):
    """Cells after all events, taken as writes."""
    e = F.col("event_id")
    writes = events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (e % 10).alias("row_idx"), (e % 37).alias("col_idx"), "event_id", F.when(e % 5 == 0, " ").otherwise(F.left("event_type", F.lit(1))).alias("ch"))
    return edit.replayed_cells(writes, ["doc_id", "row_idx", "col_idx"], "event_id")


@register(
    "edit_replay_rope", "doc_id:l text:s",
    """WITH RECURSIVE edits AS (
      SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS piece, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 11 END AS s, event_id % 11 + event_id % 4 AS e,
        CASE WHEN event_id % 7 = 0 OR event_id % 3 = 1 THEN 'insert' WHEN event_id % 3 = 0 THEN 'delete' ELSE 'replace' END AS op FROM events),
    replayed AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS n, '' AS text FROM edits WHERE n = 1
      UNION ALL
      SELECT r.doc_id, e.n, CASE WHEN op = 'insert' AND s <= length(text) THEN text[1:s] || piece || text[s + 1:] WHEN op = 'delete' AND s < e AND e <= length(text) THEN text[1:s] || text[e + 1:]
        WHEN op = 'replace' AND s <= e AND e <= length(text) THEN text[1:s] || piece || text[e + 1:] ELSE text END AS text
      FROM replayed AS r JOIN edits AS e ON e.doc_id = r.doc_id AND e.n = r.n + 1) @@
    SELECT doc_id, arg_max(text, n) AS text FROM replayed GROUP BY 1""",
)
def edit_replay_rope(spark, sf_dir):
    """Each user's text after all events, taken as edits."""
    e = F.col("event_id")
    ops = F.when(e % 3 == 0, "delete").when(e % 3 == 1, "insert").otherwise("replace")
    edits = events(spark, sf_dir).select(
        F.col("user_id").alias("doc_id"), e.alias("seq"), F.when(e % 7 == 0, "insert").otherwise(ops).alias("op"), F.when(e % 7 == 0, 0).otherwise(e % 11).alias("start"), (e % 11 + e % 4).alias("end"), F.col("event_type").alias("piece")
    )
    return rope.replayed_text(edits)


@register(
    "anchor_sessions", "user_id:l session:l n:l first_event:l",
    """WITH RECURSIVE seconds AS (SELECT user_id, event_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS s FROM events), places AS (SELECT DISTINCT user_id, s FROM seconds),
    starts AS (SELECT user_id, min(s) AS a FROM places GROUP BY 1 UNION ALL SELECT p.user_id, min(p.s) FROM starts AS t JOIN places AS p ON p.user_id = t.user_id AND p.s >= t.a + 86400 GROUP BY 1),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS session FROM starts) @@
    SELECT e.user_id, session, count(*) AS n, min(event_id) AS first_event FROM seconds AS e ASOF JOIN numbered AS m ON e.user_id = m.user_id AND e.s >= m.a GROUP BY 1, 2""",
)
def anchor_sessions(spark, sf_dir):
    """Users' events in sessions of at most a day from a session's first event."""
    timed = events(spark, sf_dir).select("user_id", "event_id", F.expr("cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as double)").alias("s"))
    return anchors.anchored(timed, "user_id", "s", 86400.0).groupBy("user_id", F.col("line_idx").alias("session")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
