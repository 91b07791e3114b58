"""Queries over the four-table export, as it was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export
from ..sources import exports, folders, views
from .base import register

_PART = "regexp_extract_all(html, '<(h1|h2|h3|p|li|table)((?:\\s[^>]*)?)>((?:<(?:b|strong|i|em|u)>)*)([^<]*)', {})"
TABLES = f"""found AS (
  SELECT page_id, unnest(range(len(a))) AS k, unnest(h) AS html, unnest(a) AS kind, coalesce(unnest(b), '') AS attributes, coalesce(unnest(c), '') AS marks, unnest(d) AS text
  FROM (SELECT page_id, {_PART.format(0)} AS h, {_PART.format(1)} AS a, {_PART.format(2)} AS b, {_PART.format(3)} AS c, {_PART.format(4)} AS d FROM pages) AS q),
elements AS (
  SELECT page_id * 4294967296 + k AS element_id, page_id AS export_id, kind AS element_type, k AS element_order, text AS element_text, html AS element_html, page_id % 60 AS page_number,
    '{{"page": ' || (page_id % 60) || ', "level": ' || CASE WHEN kind IN ('h1', 'h2', 'h3') THEN substr(kind, 2, 1) ELSE '0' END || ', "position": ' || k || '}}' AS element_metadata,
    regexp_matches(marks, '<(b|strong)>') OR (page_id * 7 + k) % 5 = 0 AS style_bold, regexp_matches(marks, '<(i|em)>') OR (page_id * 5 + k) % 7 = 0 AS style_italic,
    regexp_matches(marks, '<(u)>') OR (page_id * 3 + k) % 11 = 0 AS style_underline,
    coalesce(try_cast(regexp_extract(attributes, 'font-size:\\s*([0-9]+(?:\\.[0-9]+)?)pt', 1) AS DOUBLE), CASE kind WHEN 'h1' THEN 24e0 WHEN 'h2' THEN 18e0 WHEN 'h3' THEN 14e0 ELSE 12e0 END) AS font_size,
    CASE WHEN regexp_extract(attributes, '[;\\s"]color:\\s*(#[0-9a-fA-F]{{6}})', 1) <> '' THEN lower(regexp_extract(attributes, '[;\\s"]color:\\s*(#[0-9a-fA-F]{{6}})', 1))
      ELSE '#' || printf('%06x', (page_id * 2654435 + k * 97) % 16777216) END AS font_color,
    CASE WHEN kind IN ('h1', 'h2', 'h3') THEN 'header' WHEN kind = 'table' THEN 'data_table' WHEN contains(text, '$') THEN 'financial_text' ELSE 'body_text' END AS semantic_role,
    len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS word_count, length(text) AS char_count, ((page_id * 3 + k) % 21) / 20e0 AS confidence_score
  FROM found)"""
_COLUMNS = """element_id:l export_id:l element_type:s element_order:l element_text:s element_html:s page_number:l element_metadata:s style_bold:b style_italic:b style_underline:b
  font_size:d font_color:s semantic_role:s word_count:l char_count:l confidence_score:d"""


def written(spark, sf_dir):
    """The pages' export, written and opened again."""
    folder = folders.scratch(spark)
    export.write_export(exports.export_frames(views.table(spark, sf_dir, "pages")), folder)
    return export.open_export(spark, folder)


@register("export_elements", _COLUMNS, f"WITH {TABLES} @@ SELECT * FROM elements")
def export_elements(spark, sf_dir):
    """Every element with its styles and semantics, joined from the export's bucketed tables."""
    return written(spark, sf_dir).elements()


@register(
    "export_summary",
    "export_id:l exported_s:l source_path:s qc_user:s edit_count:l changed:b elements:l bold:l headers:l bold_financial:l words:l chars:l least_confidence:d largest_font:d",
    f"""WITH {TABLES}, summed AS (
      SELECT export_id, count(*) AS elements, count(*) FILTER (style_bold) AS bold, count(*) FILTER (semantic_role = 'header') AS headers, count(*) FILTER (style_bold AND semantic_role = 'financial_text') AS bold_financial,
        sum(word_count) AS words, sum(char_count) AS chars, min(confidence_score) AS least_confidence, max(font_size) AS largest_font FROM elements GROUP BY 1) @@
      SELECT page_id AS export_id, 1700000000 + page_id * 61 AS exported_s, 'scans/' || (page_id % 100) || '/' || page_id || '.pdf' AS source_path, 'qc' || (page_id % 7) AS qc_user,
        (length(html) - length(replace(html, '<b>', ''))) // 3 AS edit_count, contains(html, '<b>') AS changed, elements, bold, headers, bold_financial, words, chars, least_confidence, largest_font
      FROM pages LEFT JOIN summed ON page_id = export_id""",
)
def export_summary(spark, sf_dir):
    """Each export with its edits and what its elements hold, from all four tables."""
    return export.summary(written(spark, sf_dir))


@register(
    "export_round_trip", "element_id:l element_type:s element_text:s element_metadata:s style_bold:b semantic_role:s",
    f"WITH {TABLES} @@ SELECT * FROM elements WHERE semantic_role = 'financial_text' AND style_bold OR element_type IN ('h1', 'h2', 'h3')",
)
def export_round_trip(spark, sf_dir):
    """Bold financial text, and headers, out of the exported tables as they were written."""
    wanted = (F.col("semantic_role") == "financial_text") & F.col("style_bold") | F.col("element_type").isin("h1", "h2", "h3")
    return written(spark, sf_dir).elements().where(wanted)
