"""Reports' edges, highlight precedence and the sweeps of merged regions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import grouping, report, search
from vellum.functions import text as T


def sweeps(xs):
    """(x, width, seed, cells) by the sequential rule: a seed sweeps all open cells until it takes none."""
    done, out = [False] * len(xs), []
    for i, x in enumerate(xs):
        if done[i]:
            continue
        a, b, took, done[i], grew = x, x + 1, [i], True, True
        while grew:
            grew = False
            for j, c in enumerate(xs):
                if not done[j] and (abs(c - b) <= 2 or abs(a - c - 1) <= 2):
                    a, b, done[j], grew = min(a, c), max(b, c + 1), True, True
                    took.append(j)
        out.append((a, b - a, i, "".join(chr(0x4E00 + j) for j in took)))
    return out


def test_sweeps():
    rng = random.Random(8)
    for n, wide in [(rng.randint(1, 120), rng.choice([5, 30, 90, 400])) for _ in range(250)] + [(600, 300)]:
        xs = [rng.randint(0, wide) for _ in range(n)]
        got = grouping._greedy(np.arange(n), np.array(xs), np.array([chr(0x4E00 + j) for j in range(n)], object))
        assert got == sweeps(xs)


def test_a_long_row_is_swept_fast():
    """Each sweep of a row that comes from right to left takes one cell: halving keeps that from being quadratic."""
    n = 100_000
    got = grouping._greedy(np.arange(n), np.arange(n)[::-1] * 2, np.full(n, "c", object))
    assert [(x, w) for x, w, _, _ in got] == [(0, 2 * n - 1)]


def test_ordered_rows_need_no_python(spark):
    cells = [(1, 0, i, x, 0, "c") for i, x in enumerate((0, 1, 1, 4, 8, 9))] + [(2, 0, 0, 5, 0, "d"), (3, 0, 0, 9, 0, "x"), (3, 0, 1, 2, 0, "y")]
    frame = spark.createDataFrame(cells, "doc_id long, page int, region_id long, x int, y int, ch string")
    rows = frame.groupBy("doc_id", "page", "y").agg(F.array_sort(F.collect_list(F.struct("region_id", "x", "ch"))).alias("cells"))
    native = grouping._ordered_rows(rows.where("doc_id < 3"))
    assert "Pandas" not in native._jdf.queryExecution().executedPlan().toString()
    want = sorted((r.doc_id, r.x, r.width, r.region_id, r.text) for r in grouping.merge_islands(frame.where("doc_id < 3")).collect())
    assert sorted((r.doc_id, r.x, r.width, r.region_id, r.text) for r in native.collect()) == want
    assert len(grouping.merge_exact(frame).collect()) == len(want) + 2
    assert grouping.merge_exact(frame.where("false")).count() == 0


@pytest.mark.parametrize("text", ["é" * 40, "x" * 51, "x" * 50, "漢" * 17, "ab🙂" * 12 + "é🙂", "y" * 49 + "é", ""])
def test_first_bytes(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.first_bytes(F.col("t"), 50)).first()[0]
    assert got == text.encode()[:50].decode(errors="ignore")


def test_console_edges(spark):
    """White space of any kind is no text; the first five regions count, blank or not."""
    shape = "doc_id long, width int, height int, lines array<string>, objects int, regions array<struct<i:int,x:int,y:int,width:int,height:int,confidence:double,text:string>>"
    regions = lambda *texts: [(i, 0, i, 1, 1, 0.25, t) for i, t in enumerate(texts)]
    rows = [(1, 2, 1, ["a"], 1, regions("\t", " \xa0", "é" * 40, " x", "\x0b\r\n", "late")), (2, 2, 1, ["a"], 1, regions(*["\t"] * 5, "late"))]
    text = {r.doc_id: r.text for r in report.console_report(spark.createDataFrame(rows, shape)).collect()}
    assert [x for x in text[1].split("\n") if "Found" in x] == [f'✅ Found text region 3: "{"é" * 25}..." (Confidence: 25.0%)', '✅ Found text region 4: " x" (Confidence: 25.0%)']
    assert "Found" not in text[2] and all(x in text[2] for x in report.DEFAULTS)


def test_highlight_precedence(spark):
    """Against a style for each cell."""
    rng = random.Random(6)
    rows = [(d, r, "x" * rng.choice([0, 1, 12, 30])) for d in range(12) for r in range(6)]
    size = {(d, r): len(t) for d, r, t in rows}
    marks = [(d, *(rng.randint(0, 8) for _ in range(2)), *(rng.randint(0, 35) for _ in range(2))) for d in range(12) for _ in range(2)]
    marks = [(d, r0, c0, r1, c1) for d, r0, r1, c0, c1 in marks]
    cursors = [(d, rng.randint(0, 7), rng.randint(0, 33)) for d in range(11)]
    hits = sorted({(d, r, c) for d, r in size for c in range(max(0, size[d, r] - 2)) if rng.random() < 0.3})
    style = {}
    for d, r, c in hits:
        style.update({(d, r, c + i): "hit" for i in range(3)})
    style.update({(d, r, c): "cursor" for d, r, c in cursors if c < size.get((d, r), 0)})
    for d, r0, c0, r1, c1 in marks:
        style.update({(d, r, c): "selection" for r in range(min(r0, r1), max(r0, r1) + 1) for c in range(min(c0, c1), max(c0, c1) + 1) if c < size.get((d, r), 0)})
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = search.highlight_runs(
        frame(rows, "doc_id int, row_idx int, text string"), frame(marks, "doc_id int, r0 int, c0 int, r1 int, c1 int"), frame(cursors, "doc_id int, row_idx int, col int"), frame(hits, "doc_id int, row_idx int, col_char int"), 3
    ).collect()
    cells = [((r.doc_id, r.row_idx, c), r.style) for r in got for c in range(r.start, r.end)]
    assert len(cells) == len(dict(cells)) and dict(cells) == style
    ends = {(r.doc_id, r.row_idx, r.end, r.style) for r in got}
    assert not [r for r in got if (r.doc_id, r.row_idx, r.start, r.style) in ends]
