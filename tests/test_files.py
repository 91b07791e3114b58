import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import grid
from vellum.sources import readers, text_files


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, text string")


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"d{i} é.txt", "".join(rng.choice("ab\r\né漢\x00🙂") for _ in range(rng.randint(0, 40)))) for i in range(700)] + [("none", None)]
    folder = str(tmp_path / "out")
    text_files.write_texts(frame(spark, rows).repartition(7), folder)
    read = text_files.read_files(spark, [folder], texts=True).where("is_file")
    assert {r["name"]: r.text for r in read.collect()} == {n: t or "" for n, t in rows}
    # no folder a document, and a partition for each folder there is
    inner = [f for f in os.listdir(folder) if f != text_files.MARK]
    assert len(inner) <= text_files.SHARDS and read.rdd.getNumPartitions() == len(inner) + 1
    assert not any(f.startswith(".") for _, _, files in os.walk(folder) for f in files)
    assert {r.text for r in text_files.read_files(spark, [folder]).collect()} == {None}


def test_nothing_is_seen_of_a_failed_write(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="no name"):
        text_files.write_texts(frame(spark, [(f"f{i}", "x") for i in range(50)] + [("a/b", "y")]).repartition(3), folder)
    assert not os.path.exists(folder)
    text_files.write_texts(frame(spark, [("a", "1")]), folder)
    with pytest.raises(Exception, match="exists"):
        text_files.write_texts(frame(spark, [("a", "2")]), folder)
    assert text_files.read_files(spark, [folder], texts=True).where("is_file").first().text == "1"
    os.remove(os.path.join(folder, text_files.MARK))
    with pytest.raises(Exception, match="complete"):
        text_files.read_files(spark, [folder]).collect()


def test_listings(spark, tmp_path):
    """Folders of other programs, files of no bytes, a folder that isn't there, names that only look like it."""
    for name in ("b.pdf", "a.pdf", "c.PDF", ".pdf", "dpdf", "e.pdf.txt"):
        (tmp_path / "two" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "two" / name).write_text("" if name == "a.pdf" else "x")
    (tmp_path / "two" / "z.pdf").mkdir()
    (tmp_path / "one").mkdir()
    folders = [str(tmp_path / n) for n in ("one", "missing", "two")]
    files = text_files.read_files(spark, folders, marked=False)
    assert [(r["rank"], r["name"], r["size"]) for r in readers.pdf_paths(files).collect()] == [(2, "a.pdf", 0), (2, "b.pdf", 1)]
    assert readers.first_pdf(files).first()["path"] == "a.pdf"
    assert readers.first_pdf(text_files.read_files(spark, folders[:2], marked=False)).count() == 0


def test_grids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab\nc"), (2, "")], "doc_id long, text string")
    grid.write_grids(grid.text_grid(docs), str(tmp_path / "out"), numbers=True)
    got = {r["name"]: r.text.split("\n") for r in text_files.read_files(spark, [str(tmp_path / "out")], texts=True).where(F.col("is_file")).collect()}
    assert got["1.matrix.txt"][:3] == ["   1 ab", "   2 c ", "   3   "] and len(got["1.matrix.txt"]) == 25 and len(got["2.matrix.txt"][0]) == 85


def test_empty(spark, tmp_path):
    text_files.write_texts(frame(spark, []), str(tmp_path / "out"))
    assert text_files.read_files(spark, [str(tmp_path / "out")]).count() == 0
