"""Layout views of plain tables: positioned words, text segments, ALTO XML, structured text, and the element tables of the export.

The formulas give every word and line of ``documents`` an exact position in
points, so the layout operators have whole tables of any size to work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_starts
from .folders import ship

PAGE_LINES, PAGE_HEIGHT = 60, 792.0

#: Tasks that ``dealt`` makes at most.
MOST_PARTS = 16384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task of ``dealt`` gets: what they unfold to, some 50 times as much, is sorted in memory.
DEALT = 2 << 20


def _size(docs: DataFrame) -> int:
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(docs: DataFrame) -> DataFrame:
    """docs dealt out by id while they are narrow; what follows by document, or by parts of it, shuffles nothing that they unfold to.

    A larger table goes to more tasks: Spark would make them of the size of what is shuffled, which is not what it unfolds to.
    """
    parts = min(-(-_size(docs) // DEALT), MOST_PARTS)
    few = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(parts, "doc_id") if parts > few else docs.repartition("doc_id")


def spread(docs: DataFrame) -> DataFrame:
    """For plans that stay within rows: docs as they are read, or dealt out if the table is too small for its scan to use all cores."""
    spark = docs.sparkSession
    per_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return dealt(docs) if _size(docs) < per_task * spark.sparkContext.defaultParallelism else docs


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, r, text): one row for each line, from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("r", "text"))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, r, j, off, content, last): pieces between single spaces; off is a piece's first character in its line.

    Offsets come from the line itself: a window over words would shuffle all of them.
    """
    pieces = with_starts(lines(docs).withColumn("p", F.split("text", " ", -1)), "p", "at")
    each = pieces.select("doc_id", "r", F.size("p").alias("n"), F.posexplode(F.arrays_zip(F.col("p").alias("content"), F.col("at").alias("off"))).alias("j", "x"))
    return each.select("doc_id", "r", "j", F.col("x.off").alias("off"), F.col("x.content").alias("content"), (F.col("j") == F.col("n") - 1).alias("last"))


def elements(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, content, hpos, vpos, width, height): positioned words."""
    jitter = F.pmod(F.col("doc_id") * 31 + F.col("r") * 7 + F.col("j") * 13, F.lit(16)) * F.lit(0.5)
    return (
        words(docs)
        .where("content <> ''")
        .select(
            "doc_id",
            (F.col("r").cast("long") * (1 << 31) + F.col("j")).alias("ord"),
            "content",
            (F.lit(6.0) * F.col("off")).alias("hpos"),
            (F.lit(12.0) * F.col("r") + jitter).alias("vpos"),
            (F.lit(6.0) * F.length("content")).alias("width"),
            F.lit(10.0).alias("height"),
        )
    )


def segments(docs: DataFrame, pitch: float = 7.0) -> DataFrame:
    """(doc_id, page, seq, text, x, y, w, h): one text segment a line that isn't blank."""
    on_page = F.col("r") % PAGE_LINES
    return (
        lines(docs)
        .where(F.col("text").rlike("(?U)\\S"))
        .select(
            "doc_id",
            F.expr(f"cast(r div {PAGE_LINES} as int)").alias("page"),
            F.col("r").alias("seq"),
            "text",
            (F.lit(36.0) + F.lit(6.0) * (F.col("doc_id") % 5)).alias("x"),
            (F.lit(24.0) + F.lit(pitch) * on_page).alias("y"),
            (F.lit(5.5) * F.length("text")).alias("w"),
            F.when(on_page == 0, 16.0).otherwise(F.lit(10.0) + F.lit(2.0) * ((F.col("doc_id") + F.col("r")) % 3)).alias("h"),
        )
    )


def alto_xml(docs: DataFrame) -> DataFrame:
    """(doc_id, xml): a page of String elements for each document, in order."""
    escaped = F.replace(F.replace(F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    tag = F.concat(F.lit("<String"), attribute("CONTENT", escaped), *[attribute(c.upper(), F.col(c).cast("string")) for c in ("hpos", "vpos", "width", "height")], F.lit("/>"))
    tags = elements(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", tag.alias("tag")))).alias("t"))
    return tags.select("doc_id", F.concat(F.lit("<alto><Page>"), F.array_join(F.transform("t", lambda x: x["tag"]), ""), F.lit("</Page></alto>")).alias("xml"))


_BLOCK = r"<(h1|h2|h3|p|li)(?:\s[^>]*)?>(<b>)?([^<]*)"


def content(pages: DataFrame) -> DataFrame:
    """The content table: elements of a page in order, with bold and number within the page beside it."""
    part = lambda g: F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(g))
    zipped = F.arrays_zip(part(1).alias("kind"), part(2).alias("bold"), part(3).alias("text"))
    each = pages.select("page_id", F.posexplode(zipped).alias("k", "x"))
    key = F.col("page_id") * (1 << 32) + F.col("k")
    return each.select(
        key.alias("content_id"),
        key.alias("element_id"),
        F.col("x.kind").alias("element_type"),
        F.col("x.text").alias("element_text"),
        F.format_string('{"page": %d}', F.col("page_id") % 60).alias("element_metadata"),
        ((F.coalesce("x.bold", F.lit("")) != "") | ((F.col("page_id") * 7 + F.col("k")) % 5 == 0)).alias("_bold"),
    )


def export_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(content, styles, semantics)."""
    every = content(pages)
    role = F.when(F.col("element_type").isin("h1", "h2", "h3"), "header").when(F.col("element_text").contains("$"), "financial_text").otherwise("body_text")
    return every.drop("_bold"), every.select("element_id", F.col("_bold").alias("style_bold")), every.select("element_id", role.alias("semantic_role"))
