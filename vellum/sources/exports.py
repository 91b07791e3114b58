"""The four export tables of web pages, with all columns that the export describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An element's tag, attributes, formatting tags and text.
ELEMENT = r"<(h1|h2|h3|p|li|table)((?:\s[^>]*)?)>((?:<(?:b|strong|i|em|u)>)*)([^<]*)"
#: Points of each kind of element, where it says nothing else.
SIZES = {"h1": 24.0, "h2": 18.0, "h3": 14.0}
BODY_SIZE = 12.0


def _elements(pages: DataFrame) -> DataFrame:
    part = lambda g: F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(g))
    zipped = F.arrays_zip(part(0).alias("html"), part(1).alias("kind"), part(2).alias("attributes"), part(3).alias("marks"), part(4).alias("text"))
    each = pages.select("page_id", F.posexplode(zipped).alias("k", "x"))
    return each.select("page_id", "k", (F.col("page_id") * (1 << 32) + F.col("k")).alias("element_id"), *[F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c) for c in ("html", "kind", "attributes", "marks", "text")])


def content(elements: DataFrame) -> DataFrame:
    level = F.when(F.col("kind").rlike("^h[1-3]$"), F.substring("kind", 2, 1)).otherwise("0")
    metadata = F.concat(F.lit('{"page": '), F.col("page_id") % 60, F.lit(', "level": '), level, F.lit(', "position": '), F.col("k"), F.lit("}"))
    return elements.select(
        "element_id", F.col("element_id").alias("content_id"), F.col("page_id").alias("export_id"), F.col("kind").alias("element_type"), F.col("k").alias("element_order"),
        F.col("text").alias("element_text"), F.col("html").alias("element_html"), (F.col("page_id") % 60).cast("int").alias("page_number"), metadata.alias("element_metadata"),
    )


def styles(elements: DataFrame) -> DataFrame:
    """Flags from the formatting tags, and by number for every fifth, seventh and eleventh element; size and colour from the attributes where they are given."""
    number = lambda a, n: (F.col("page_id") * a + F.col("k")) % n == 0
    marked = lambda *tags: F.col("marks").rlike("<(" + "|".join(tags) + ")>")
    size = F.regexp_extract("attributes", r"font-size:\s*([0-9]+(?:\.[0-9]+)?)pt", 1).try_cast("double")
    own = F.lit(BODY_SIZE)
    for kind, points in SIZES.items():
        own = F.when(F.col("kind") == kind, points).otherwise(own)
    colour = F.regexp_extract("attributes", r"[;\s\"]color:\s*(#[0-9a-fA-F]{6})", 1)
    shade = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("page_id") * 2654435 + F.col("k") * 97) % 16777216), 6, "0")))
    return elements.select(
        "element_id", (marked("b", "strong") | number(7, 5)).alias("style_bold"), (marked("i", "em") | number(5, 7)).alias("style_italic"), (marked("u") | number(3, 11)).alias("style_underline"),
        F.coalesce(size, own).alias("font_size"), F.when(colour != "", F.lower(colour)).otherwise(shade).alias("font_color"),
    )


def semantics(elements: DataFrame) -> DataFrame:
    kind, text = F.col("kind"), F.col("text")
    role = F.when(kind.isin("h1", "h2", "h3"), "header").when(kind == "table", "data_table").when(text.contains("$"), "financial_text").otherwise("body_text")
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0)))
    return elements.select("element_id", role.alias("semantic_role"), words.alias("word_count"), F.length(text).alias("char_count"), (((F.col("page_id") * 3 + F.col("k")) % 21) / F.lit(20.0)).alias("confidence_score"))


def exports(pages: DataFrame) -> DataFrame:
    """One export for each page: its edits are the bold tags made strong ones."""
    edits = (F.length("html") - F.length(F.replace("html", F.lit("<b>"), F.lit("")))) / 3
    return pages.select(
        F.col("page_id").alias("export_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 61).alias("exported_at"), F.concat(F.lit("scans/"), F.col("page_id") % 100, F.lit("/"), F.col("page_id"), F.lit(".pdf")).alias("source_path"),
        F.col("html").alias("original_html"), F.replace("html", F.lit("<b>"), F.lit("<strong>")).alias("edited_html"), F.concat(F.lit("qc"), F.col("page_id") % 7).alias("qc_user"), edits.cast("int").alias("edit_count"),
    )


def export_frames(pages: DataFrame) -> dict[str, DataFrame]:
    """exports, content, styles and semantics of pages (page_id, html)."""
    elements = _elements(pages)
    return {"exports": exports(pages), "content": content(elements), "styles": styles(elements), "semantics": semantics(elements)}
