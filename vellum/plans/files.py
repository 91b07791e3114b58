"""Queries that write texts as files and read them back, and queries over lines and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edit, geometry, grid, grouping
from ..sources import folders, readers, text_files, views
from .base import ELEMENTS, GRID, LINES, WORDS, by_document, documents, register, segments_sql


@register("saved_texts", "doc_id:l text:s", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def saved_texts(spark, sf_dir):
    """Each document's text, written to a file of its own and read back."""
    folder = folders.scratch(spark)
    text_files.write_texts(documents(spark, sf_dir).select(F.concat("doc_id", F.lit(".txt")).alias("name"), "text"), folder)
    return text_files.read_files(spark, [folder], texts=True).where("is_file").select(F.substring_index("name", ".", 1).alias("doc_id"), "text")


@register("saved_grids", "doc_id:l text:s", f"WITH {GRID} @@ SELECT doc_id, string_agg(lpad(CAST(row_idx + 1 AS VARCHAR), 4, ' ') || ' ' || text, chr(10) ORDER BY row_idx) AS text FROM grid_rows GROUP BY 1")
def saved_grids(spark, sf_dir):
    """Each document's grid, its rows numbered, written to a file of its own and read back."""
    folder = folders.scratch(spark)
    grid.write_grids(grid.text_grid(documents(spark, sf_dir)), folder, numbers=True)
    return text_files.read_files(spark, [folder], texts=True).where("is_file").select(F.substring_index("name", ".", 1).alias("doc_id"), "text")


_NAMED = """named AS (SELECT doc_id, doc_id % 3 AS rank, 'p' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' WHEN doc_id % 5 = 1 THEN '.txt' WHEN doc_id % 7 = 2 THEN 'pdf' ELSE '.pdf' END AS name, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE strlen(text) END AS size FROM documents)"""


def _files(spark, sf_dir, texts=False):
    """Three folders of documents' files, some of other kinds, some of no bytes; the first folder has no .pdf."""
    d = F.col("doc_id")
    name = F.concat(F.lit("p"), d, F.when(d % 3 == 0, ".PDF").when(d % 5 == 1, ".txt").when(d % 7 == 2, "pdf").otherwise(".pdf"))
    docs = documents(spark, sf_dir).select((d % 3).alias("rank"), name.alias("name"), F.when(d % 4 == 1, "").otherwise(F.col("text")).alias("text"))
    made = [folders.scratch(spark) for _ in range(3)]
    for rank, folder in enumerate(made):
        text_files.write_texts(docs.where(F.col("rank") == rank), folder)
    return text_files.read_files(spark, made, texts=texts)


@register("listed_pdfs", "rank:l name:s size:l", f"WITH {_NAMED} @@ SELECT rank, name, size FROM named WHERE name LIKE '%.pdf'")
def listed_pdfs(spark, sf_dir):
    """Files that end in exactly .pdf, those of no bytes too."""
    return readers.pdf_paths(_files(spark, sf_dir)).select("rank", "name", "size")


@register("first_pdf", "rank:l name:s", f"WITH {_NAMED} @@ SELECT rank, name FROM named WHERE name LIKE '%.pdf' ORDER BY rank, name LIMIT 1")
def first_pdf(spark, sf_dir):
    """The first file of the first folder that has one with the extension."""
    return readers.first_pdf(_files(spark, sf_dir)).select("rank", "name")


@register(
    "file_rejections", "doc_id:l reason:s",
    f"WITH {_NAMED} @@ SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not found' WHEN doc_id % 13 = 0 THEN 'not a file' WHEN name NOT LIKE '%.pdf' THEN 'not a pdf' END AS reason FROM named",
)
def file_rejections(spark, sf_dir):
    """Why a document's file can't be opened: it isn't there, is a folder, or of another kind; by the files as they are."""
    d = F.col("doc_id")
    there = _files(spark, sf_dir).withColumn("doc_id", F.regexp_extract("name", "^p([0-9]+)", 1).try_cast("long"))
    files, inner = there.where("is_file").select("doc_id", "path", "is_file"), there.where("not is_file").groupBy("path").agg(F.first("is_file").alias("folder"))
    asked = documents(spark, sf_dir).select("doc_id").join(files.select("doc_id", "path"), "doc_id")
    # for some a name that isn't there, for some the folder that their file is in
    asked = asked.withColumn("path", F.when(d % 11 == 0, F.concat("path", F.lit("x.pdf"))).when(d % 13 == 0, F.substring_index("path", "/", 1)).otherwise(F.col("path")))
    kinds = files.select("path", "is_file").union(inner.select("path", F.col("folder").alias("is_file")))
    found = asked.join(kinds, "path", "left")
    return found.select("doc_id", readers.rejection(F.col("is_file").isNotNull(), F.coalesce("is_file", F.lit(False)), F.col("path")).alias("reason"))


@register("max_vpos", "doc_id:l max_vpos:d bottom:l", f"WITH {LINES}, {WORDS}, {ELEMENTS} @@ SELECT doc_id, greatest(max(vpos), 0e0) AS max_vpos, floor(greatest(max(vpos), 0e0) / 12) + 3 AS bottom FROM elements GROUP BY 1")
def max_vpos(spark, sf_dir):
    """The lowest word of each document, and the row below it."""
    return grouping.max_vpos(views.elements(by_document(spark, sf_dir)))


@register(
    "flipped_segments", "doc_id:l page:l seq:l y:d",
    f"WITH {LINES}, {segments_sql()} @@ SELECT doc_id, page, seq, 792e0 - y AS y FROM segments",
)
def flipped_segments(spark, sf_dir):
    """Segments' heads measured from the page's foot."""
    return views.segments(documents(spark, sf_dir)).select("doc_id", "page", "seq", geometry.flipped(F.col("y"), views.PAGE_HEIGHT).alias("y"))


@register(
    "z_priorities", "doc_id:l page:l z:l n:l",
    f"""WITH {LINES}, {segments_sql()}, top AS (SELECT doc_id, page, max(y) AS most FROM segments GROUP BY 1, 2) @@
      SELECT s.doc_id, s.page, CASE WHEN h > 14 THEN CASE WHEN y < 100 THEN 150 ELSE 125 END WHEN y > most - 100 THEN 75 ELSE 100 END AS z, count(*) AS n
      FROM segments AS s JOIN top AS t ON s.doc_id = t.doc_id AND s.page = t.page GROUP BY 1, 2, 3""",
)
def z_priorities(spark, sf_dir):
    """Segments of each page by their priority."""
    segments = views.segments(by_document(spark, sf_dir))
    most = segments.groupBy("doc_id", "page").agg(F.max("y").alias("most"))
    z = T.z_priority(F.col("h"), F.col("y"), F.col("most"))
    return segments.join(most, ["doc_id", "page"]).groupBy("doc_id", "page", z.alias("z")).agg(F.count("*").alias("n"))


@register("select_all", "doc_id:l sel_start:l sel_end:l text:s", "SELECT doc_id, 0 AS sel_start, length(text) AS sel_end, text FROM documents")
def select_all(spark, sf_dir):
    """Each whole text selected, and the text in the selection."""
    chosen = edit.select_all(documents(spark, sf_dir))
    return chosen.select("doc_id", "sel_start", "sel_end", edit.selected_text(F.col("text"), F.col("sel_start"), F.col("sel_end")).alias("text"))
