"""Cursors in running texts, and the lines that tell where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_ranges(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, r, text) with their first character's place, and the place and reach of the lines around.

    A line's reach is its length, but the last line's is one less: one character is
    taken off for a line feed that it lacks.
    """
    order = Window.partitionBy("doc_id").orderBy("r")
    size = F.length("text").cast("long")
    placed = lines.withColumn("size", size).withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.lead("r").over(order).isNull()
    placed = placed.withColumn("reach", F.when(last, F.greatest(F.col("size") - 1, F.lit(0))).otherwise(F.col("size")))
    around = {f"{side}_{c}": f(c).over(order) for side, f in (("above", F.lag), ("below", F.lead)) for c in ("start", "reach")}
    return placed.withColumns(around)


def at_line(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """Cursors (doc_id, position) with the line they are in and their column."""
    inside = line_ranges(lines).join(cursors, "doc_id").where((F.col("start") <= F.col("position")) & (F.col("position") <= F.col("start") + F.col("size")))
    return inside.withColumn("line_idx", F.col("r")).withColumn("col", F.col("position") - F.col("start"))


def moved(cursors: DataFrame, length: Column) -> DataFrame:
    """(doc_id, position, up, down, left, right): where a key moves each cursor of at_line; up and down keep the column as far as the line goes."""
    up = F.coalesce(F.col("above_start") + F.least("col", "above_reach"), F.col("position"))
    down = F.coalesce(F.col("below_start") + F.least("col", "below_reach"), F.col("position"))
    left, right = F.greatest(F.col("position") - 1, F.lit(0)), F.least(F.col("position") + 1, length)
    return cursors.select("doc_id", "position", up.alias("up"), down.alias("down"), left.alias("left"), right.alias("right"))


def line_ends(cursors: DataFrame) -> DataFrame:
    """(doc_id, position, home, end): where Home and End move each cursor of at_line."""
    return cursors.select("doc_id", "position", F.col("start").alias("home"), (F.col("start") + F.col("reach")).alias("end"))


def editor_status(line: Column, col: Column, selected: Column) -> Column:
    """The editor's status line; ``selected`` characters, null without a selection."""
    place = F.format_string("Line %d, Col %d ", line + 1, col + 1)
    return F.concat(place, F.coalesce(F.when(selected.isNotNull(), F.format_string("| SEL: %d chars ", selected)), F.lit("")))


def grid_status(width: Column, height: Column, filled: Column) -> Column:
    return F.format_string("SPATIAL: %dx%d grid, %d chars", width, height, filled)


def page_status(width: Column, height: Column, page: Column, regions: Column, objects: Column) -> Column:
    return F.format_string("Character Matrix (%dx%d) - Page %d | Text Regions: %d | Objects: %d", width, height, page + 1, regions, objects)


def default_range(pages: Column) -> Column:
    return F.when(pages > 20, "1-10").otherwise("")
