"""Registering queries, and the views of vellum.sources in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_TYPES = {"l": ("long", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For plans that stay within a document."""
    return views.spread(views.table(spark, sf_dir, "documents"))


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For plans that group what documents unfold to."""
    return views.dealt(views.table(spark, sf_dir, "documents"))


def register(name: str, columns: str, sql: str | None):
    """Decorates f(spark, sf_dir).  columns: name:type pairs, the types l, d, s and b, cast to in both languages."""
    typed = [c.split(":") for c in columns.split()]

    def add(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*[F.col(c).cast(_TYPES[t][0]).alias(c) for c, t in typed])

        query.__name__, query.__doc__ = name, f.__doc__
        QUERIES[name] = query
        if sql:
            head, body = sql.rsplit("@@", 1) if "@@" in sql else ("", sql)
            ORACLE_SQL[name] = f"{head} SELECT {', '.join(f'CAST("{c}" AS {_TYPES[t][1]}) AS "{c}"' for c, t in typed)} FROM ({body}) AS result"
        return f

    return add


LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS r, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS q)"
WORDS = """words AS (
  SELECT doc_id, r, j, content, n, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id, r ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT doc_id, r, len(p) AS n, unnest(range(len(p))) AS j, unnest(p) AS content FROM (SELECT doc_id, r, string_split(text, ' ') AS p FROM lines) AS q1) AS q2)"""
ELEMENTS = """elements AS (
  SELECT doc_id, r * 2147483648 + j AS ord, content, 6e0 * off AS hpos, 12e0 * r + ((doc_id * 31 + r * 7 + j * 13) % 16) * 5e-1 AS vpos, 6e0 * length(content) AS width, 10e0 AS height
  FROM words WHERE content <> '')"""
SEGMENTS = """segments AS (
  SELECT doc_id, r // 60 AS page, r AS seq, text, 36e0 + 6e0 * (doc_id % 5) AS x, 24e0 + {pitch} * (r % 60) AS y, 55e-1 * length(text) AS w,
    CASE WHEN r % 60 = 0 THEN 16e0 ELSE 10e0 + 2e0 * ((doc_id + r) % 3) END AS h
  FROM lines WHERE regexp_matches(text, '[^\\s]'))"""
GLYPHS = """glyphs AS (
  SELECT doc_id, page, seq, i, ch, x0, y AS y0, x0 + CASE WHEN ch = ' ' THEN a * 5e-1 ELSE a END AS x1, y + h * 8e-1 AS y1, h * 8e-1 AS font_size FROM (
    SELECT *, x + a * (i - 5e-1 * coalesce(sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS x0
    FROM (SELECT doc_id, page, seq, x, y, h, w / length(text) AS a, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch FROM segments) AS q1) AS q2)"""
SIZES = """mode AS (
  SELECT doc_id, page, s FROM (SELECT doc_id, page, s, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, s) AS k
    FROM (SELECT doc_id, page, CAST(round(font_size) AS INTEGER) AS s, count(*) AS n FROM glyphs GROUP BY 1, 2, 3) AS q1) AS q2 WHERE k = 1),
sizes AS (
  SELECT doc_id, page, min_x, min_y, s * 6e-1 AS char_w, s * 12e-1 AS char_h,
    greatest(CAST(ceil((max_x - min_x) / (s * 6e-1)) AS INTEGER), 10) AS width, greatest(CAST(ceil((max_y - min_y) / (s * 12e-1)) AS INTEGER), 10) AS height
  FROM (SELECT doc_id, page, min(x0) AS min_x, max(x1) AS max_x, min(y0) AS min_y, max(y1) AS max_y FROM glyphs GROUP BY 1, 2) AS e JOIN mode USING (doc_id, page))"""
CELLS = """cells AS (
  SELECT doc_id, page, x, y, ch, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq, i) - 1 AS region_id FROM (
    SELECT g.doc_id, g.page, seq, i, ch, width, height, CAST(round((x0 - min_x) / char_w) AS INTEGER) AS x, CAST(round((y0 - min_y) / char_h) AS INTEGER) AS y
    FROM glyphs AS g JOIN sizes AS z ON g.doc_id = z.doc_id AND g.page = z.page) AS q WHERE x >= 0 AND x < width AND y >= 0 AND y < height)"""
STARTS = """places AS (SELECT DISTINCT doc_id, vpos FROM elements),
starts AS (
  SELECT doc_id, min(vpos) AS a FROM places GROUP BY doc_id
  UNION ALL SELECT p.doc_id, min(p.vpos) FROM starts AS s JOIN places AS p ON p.doc_id = s.doc_id AND p.vpos >= s.a + 8 GROUP BY p.doc_id),
numbered AS (SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS line_idx FROM starts),
placed AS (SELECT e.*, n.line_idx FROM elements AS e ASOF JOIN numbered AS n ON e.doc_id = n.doc_id AND e.vpos >= n.a)"""
READING = """reading AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM (
    SELECT doc_id, line_idx, string_agg(content, ' ' ORDER BY hpos, vpos, ord) AS text, arg_min(hpos, (hpos, vpos, ord)) AS first_hpos, arg_min(vpos, (hpos, vpos, ord)) AS first_vpos
    FROM placed GROUP BY 1, 2) AS q)"""
MAP = """spots AS (
  SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx, elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY hpos, vpos, ord) - 1 AS elem_idx, count(*) OVER (PARTITION BY doc_id, line_idx) AS in_line FROM placed) AS q),
spatial AS (SELECT *, start_char + length(content) + CASE WHEN elem_idx < in_line - 1 THEN 1 ELSE 0 END AS end_char FROM spots)"""
GRID = """split AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS q),
grid AS (SELECT doc_id, l, coalesce(list_max(list_transform(l, lambda x: strlen(x))), 80) AS width, greatest(len(l), 25) AS height FROM split),
grid_rows AS (SELECT doc_id, width, height, row_idx, rpad(coalesce(l[row_idx + 1], ''), CAST(width AS INTEGER), ' ') AS text FROM (SELECT *, unnest(range(height)) AS row_idx FROM grid) AS q)"""
MARKS = """marks AS (
  SELECT *, (bottom - top + 1) * ("right" - "left" + 1) AS area FROM (
    SELECT doc_id, least(doc_id % 7, (doc_id * 5) % 12, height - 1) AS top, least(greatest(doc_id % 7, (doc_id * 5) % 12), height - 1) AS bottom,
      least((doc_id * 3) % 40, c1) AS "left", greatest((doc_id * 3) % 40, c1) AS "right"
    FROM (SELECT doc_id, height, CASE WHEN doc_id % 50 = 0 THEN 60000 ELSE (doc_id * 7) % 90 END AS c1 FROM grid) AS q1) AS q2)"""
EXPORT = r"""blocks AS (
  SELECT page_id, unnest(range(len(a))) AS k, unnest(a) AS kind, unnest(b) AS bold, unnest(c) AS text FROM (
    SELECT page_id, regexp_extract_all(html, '<(h1|h2|h3|p|li)(?:\s[^>]*)?>(<b>)?([^<]*)', 1) AS a, regexp_extract_all(html, '<(h1|h2|h3|p|li)(?:\s[^>]*)?>(<b>)?([^<]*)', 2) AS b,
      regexp_extract_all(html, '<(h1|h2|h3|p|li)(?:\s[^>]*)?>(<b>)?([^<]*)', 3) AS c FROM pages) AS q),
tables AS (
  SELECT page_id * 4294967296 + k AS element_id, kind AS element_type, text AS element_text, page_id % 60 AS page, '{"page": ' || (page_id % 60) || '}' AS element_metadata,
    coalesce(bold, '') <> '' OR (page_id * 7 + k) % 5 = 0 AS style_bold,
    CASE WHEN kind IN ('h1', 'h2', 'h3') THEN 'header' WHEN contains(text, '$') THEN 'financial_text' ELSE 'body_text' END AS semantic_role FROM blocks)"""


def segments_sql(pitch: str = "7e0") -> str:
    return SEGMENTS.replace("{pitch}", pitch)
