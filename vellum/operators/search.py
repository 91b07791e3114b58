"""Literal search in rows of text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bins import Axis, overlap_join


def find(rows: DataFrame, query: str) -> DataFrame:
    """(doc_id, row_idx, k, col_char, col_byte): places of a literal in rows (doc_id, row_idx, text), without overlap; none for an empty literal."""
    if not query:
        return rows.where("false").select("doc_id", "row_idx", F.lit(0).alias("k"), F.lit(0).alias("col_char"), F.lit(0).alias("col_byte"))
    pieces = rows.where(F.contains("text", F.lit(query))).withColumn("p", F.split("text", "\\Q" + query + "\\E" if "\\E" not in query else re.escape(query), -1))
    n, size = len(query), len(query.encode())

    def starts(measure, own):
        """Running sums of what stands before each place; rows have few places."""
        none = F.expr("cast(array() as array<int>)")
        return F.aggregate(F.slice("p", F.lit(1), F.size("p") - 1), none, lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)) + own, F.lit(0)) + measure(x)))

    zipped = F.arrays_zip(starts(F.length, n).alias("c"), starts(F.octet_length, size).alias("b"))
    return pieces.select("doc_id", "row_idx", F.posexplode(zipped).alias("k", "z")).select("doc_id", "row_idx", "k", F.col("z.c").alias("col_char"), F.col("z.b").alias("col_byte"))


def numbered_hits(hits: DataFrame) -> DataFrame:
    """Hits with their number in the document, from 0, and the next and previous hit's place, round the ends."""
    order = Window.partitionBy("doc_id").orderBy("row_idx", "col_char")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("row_idx", "col_char")
    out = hits.withColumn("hit", F.row_number().over(order) - 1).withColumn("_n", F.coalesce(F.lead(place).over(order), F.first(place).over(whole))).withColumn("_p", F.coalesce(F.lag(place).over(order), F.last(place).over(whole)))
    return out.select("doc_id", "hit", "row_idx", "col_char", F.col("_n.row_idx").alias("next_row"), F.col("_n.col_char").alias("next_col"), F.col("_p.row_idx").alias("prev_row"), F.col("_p.col_char").alias("prev_col"))


def highlighted(cells: DataFrame, hits: DataFrame) -> DataFrame:
    """Cells (doc_id, row_idx, col_char) at which a hit starts."""
    return cells.join(hits, ["doc_id", "row_idx", "col_char"], "left_semi")


#: Styles in order of precedence.
STYLES = ("selection", "cursor", "hit")


def highlight_runs(rows: DataFrame, selections: DataFrame, cursors: DataFrame, hits: DataFrame, hit_length: int = 1) -> DataFrame:
    """(doc_id, row_idx, start, end, style): the runs of each row (doc_id, row_idx, text) that have a style, as long as they can be.

    selections: (doc_id, r0, c0, r1, c1), any corner first; cursors: (doc_id, row_idx, col);
    hits: (doc_id, row_idx, col_char), of hit_length characters.  A sweep along each row counts what is open of each
    style; where several are, the first of STYLES shows.  No cell becomes a row.
    """
    sizes = rows.select("doc_id", "row_idx", F.length("text").alias("_size"))
    top, bottom, left, right = (f(a, b) for a, b in (("r0", "r1"), ("c0", "c1")) for f in (F.least, F.greatest))
    marks = selections.select("doc_id", top.alias("_top"), bottom.alias("_bottom"), left.alias("start"), (right + 1).alias("end"))
    chosen = overlap_join(sizes, marks, ["doc_id"], [Axis(F.col("row_idx"), F.col("row_idx"), F.col("_top"), F.col("_bottom"), 64)])
    spots = cursors.select("doc_id", "row_idx", F.col("col").alias("start"), (F.col("col") + 1).alias("end")).join(sizes, ["doc_id", "row_idx"])
    found = hits.select("doc_id", "row_idx", F.col("col_char").alias("start"), (F.col("col_char") + hit_length).alias("end"), F.lit(None).cast("int").alias("_size"))
    every = None
    for rank, part in enumerate((chosen, spots, found)):
        own = part.select("doc_id", "row_idx", F.greatest(F.col("start"), F.lit(0)).cast("int").alias("start"), F.least("end", "_size").cast("int").alias("end"), F.lit(rank).alias("rank")).where("start < end")
        every = own if every is None else every.union(own)
    edges = every.select("doc_id", "row_idx", "rank", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.groupBy("doc_id", "row_idx", F.col("e.at").alias("start")).agg(*[F.sum(F.when(F.col("rank") == i, F.col("e.step")).otherwise(0)).alias(f"_{i}") for i in range(len(STYLES))])
    along = Window.partitionBy("doc_id", "row_idx").orderBy("start")
    style = F.lit(None).cast("string")
    for i in reversed(range(len(STYLES))):
        style = F.when(F.sum(f"_{i}").over(along.rowsBetween(Window.unboundedPreceding, 0)) > 0, STYLES[i]).otherwise(style)
    shown = steps.withColumn("style", style).withColumn("_was", F.lag("style").over(along)).where(~F.col("style").eqNullSafe(F.col("_was")))
    return shown.withColumn("end", F.lead("start").over(along)).where("style is not null").select("doc_id", "row_idx", "start", "end", "style")
