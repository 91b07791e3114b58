"""Reports of grids and their regions, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_bytes, not_blank, numbered, pad

# The lines and heads that a console report has whatever the page.
DEFAULTS = (
    "✅ Successfully processed PDF with Ferrules ML vision model",
    "✅ Generated spatial character matrix representation",
    "✅ Preserved document layout structure",
)
ISSUES = (
    "❌ Text concatenation: Words may run together without spaces",
    "❌ Overlapping text: Multiple words placed in same positions",
    "❌ Inconsistent spacing: Some areas dense, others sparse",
    "❌ Character accuracy: OCR/vision may misread some characters",
)
CONSOLE_HEAD = "📊 Ferrules Character Matrix Output - Exact Placement Visualization"
TOGGLES = "Toggle Text Highlighting Toggle Grid Lines"
DONE_HEAD, ISSUES_HEAD = "What Ferrules Accomplished:", "Placement Issues:"


def with_regions(grids: DataFrame, regions: DataFrame) -> DataFrame:
    """Grids with the array of their regions (doc_id, i, x, y, width, height, confidence, text), in order of i."""
    own = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "width", "height", "confidence", "text"))).alias("regions"))
    none = F.expr("cast(array() as array<struct<i:int,x:int,y:int,width:int,height:int,confidence:double,text:string>>)")
    return grids.join(own, "doc_id", "left").withColumn("regions", F.coalesce("regions", none))


def _report(grids: DataFrame, *parts: Column) -> DataFrame:
    return grids.select("doc_id", F.array_join(F.concat(*parts), "\n").alias("text"))


def matrix_report(grids: DataFrame, char_w: float, char_h: float) -> DataFrame:
    """(doc_id, text): head, rule, rows, rule, regions of grids with_regions and the number of their ``objects``, all within a row."""
    rule = F.array(F.repeat(F.lit("═"), F.least("width", F.lit(80)).cast("int")))
    head = F.format_string(f"Character Matrix (%dx%d) | Char: {char_w:.1f}x{char_h:.1f}pt:", "width", "height")
    counts = F.format_string("Text Regions: %d | Original Text Objects: %d", F.size("regions"), "objects")
    row = lambda x, i: F.when(F.col("height") > 20, numbered(pad(x, F.col("width")), i, 3)).otherwise(pad(x, F.col("width")))
    told = lambda r: F.format_string('Region %d: (%d,%d) %dx%d conf:%.2f - "%s"', r["i"] + 1, r["x"], r["y"], r["width"], r["height"], r["confidence"], F.left(r["text"], F.lit(50)))
    return _report(grids, F.array(head, counts), rule, F.transform("lines", row), rule, F.transform("regions", told))


def console_report(grids: DataFrame) -> DataFrame:
    """(doc_id, text), blanks shown as dots; of the first five regions those with text, or three set lines.

    A region of white space of any kind has no text; one of over 50 bytes is cut after the last whole character within 50.
    """
    head = [F.lit(CONSOLE_HEAD), F.format_string("Matrix Size: %d columns × %d rows", "width", "height"), F.format_string("Regions Detected: %d", F.size("regions"))]
    head += [F.format_string("Text Objects: %d", "objects"), F.lit("Processing Time: N/A"), F.lit(TOGGLES)]
    rows = F.transform("lines", lambda x, i: numbered(F.translate(pad(x, F.col("width")), " ", "·"), i, 3))
    # the five come first, then the blank ones go
    found = F.filter(F.slice("regions", F.lit(1), F.lit(5)), lambda r: not_blank(r["text"]))
    preview = lambda t: F.when(F.octet_length(t) > 50, F.concat(first_bytes(t, 50), F.lit("..."))).otherwise(t)
    told = F.transform(found, lambda r: F.format_string('✅ Found text region %d: "%s" (Confidence: %.1f%%)', r["i"] + 1, preview(r["text"]), r["confidence"] * 100))
    fixed = lambda lines: F.array(*[F.lit(x) for x in lines])
    parts = [F.array(*head), rows, fixed([DONE_HEAD]), F.when(F.size(told) > 0, told).otherwise(fixed(DEFAULTS)), fixed([ISSUES_HEAD]), fixed(ISSUES)]
    return _report(grids, *parts)
