"""Cells of whole segments against cells as rows."""

import random

import numpy as np

from __spark_entry__ import queries
from vellum.operators import cells, geometry, grid, grouping
from vellum.operators.sweeps import greedy

_COLUMNS = ["doc_id", "page", "y", "x", "width", "region_id", "text"]


def _segments(spark, pitch):
    draw = random.Random(5)
    rows = []
    for doc in range(12):
        for seq in range(25):
            text = "".join(draw.choice("ab é𝄞  ") for _ in range(draw.choice([1, 1, 5, 30])))
            rows.append((doc, seq // 15, seq, text, draw.choice([0.0, 36.0, 90.0]), pitch * (seq % 15), draw.choice([1.0, 5.5, 40.0]) * len(text), draw.choice([10.0, 12.0, 16.0])))
    return spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, x double, y double, w double, h double")


def _both(spark, pitch):
    segments = _segments(spark, pitch)
    sizes = geometry.grid_size(segments)
    return cells.placed(segments, sizes), grid.glyph_cells(segments, sizes)


def _rows(frame, columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_pieces_merge_as_cells(spark):
    for pitch in (3.0, 14.0):
        placed, each = _both(spark, pitch)
        want = _rows(grouping.merge_islands(grid.regions(each)), _COLUMNS)
        assert len(want) > 100 and _rows(grouping.merge_pieces(cells.pieces(placed)), _COLUMNS) == want


def test_exact_regions_as_cells(spark):
    for pitch in (3.0, 20.0):
        placed, each = _both(spark, pitch)
        want = _rows(grouping.merge_exact(grid.regions(each)), _COLUMNS)
        assert len(want) > 100 and _rows(cells.exact_regions(placed), _COLUMNS) == want


def test_last_writer_rows_as_cells(spark):
    placed, each = _both(spark, 3.0)
    columns = ["doc_id", "page", "y", "n", "first_x", "last_x", "text"]
    want = _rows(grid.cell_rows(grid.last_writer(each)), columns)
    assert len(want) > 50 and _rows(cells.last_writer_rows(placed), columns) == want


def test_slices_do_not_show(spark, monkeypatch):
    placed, _ = _both(spark, 3.0)
    texts = placed.select("text", "a", "x", "min_x", "char_w", "width").toArrow().combine_chunks().to_batches()[0].columns
    whole = cells._pieces(*texts)
    monkeypatch.setattr(cells, "SLICE", 16)
    assert cells._pieces(*texts).equals(whole)
    assert len(cells._pieces(*[t.slice(0, 0) for t in texts])) == 0


def _sequential(number, x, ch):
    """The rule itself: a seed sweeps what is open until a sweep takes nothing."""
    left, out = list(range(len(x))), []
    while left:
        seed = left.pop(0)
        start, end, letters, grew = x[seed], x[seed] + 1, ch[seed], True
        while grew:
            grew = False
            for i in list(left):
                if abs(x[i] - end) <= 2 or abs(x[i] + 1 - start) <= 2:
                    left.remove(i)
                    start, end, letters, grew = min(start, x[i]), max(end, x[i] + 1), letters + ch[i], True
        out.append((start, end - start, number[seed], letters))
    return out


def test_sweeps_follow_the_rule():
    draw = random.Random(1)
    for trial in range(400):
        x = []
        for _ in range(draw.randint(1, 5)):
            at = draw.randint(0, 15)
            for _ in range(draw.randint(0, 12)):
                x.append(at)
                at += draw.choice([0, 1, 1, 1, 2, 3, 4, 6])
        if trial % 3 == 0:
            draw.shuffle(x)
        ch = "".join(chr(97 + i % 26) for i in range(len(x)))
        number = [3 * i for i in range(len(x))]
        assert greedy(np.array(number), np.array(x, np.int64), ch) == _sequential(number, x, ch)


def test_regions_make_no_row_of_a_cell(spark):
    """Only lines, and pieces or regions of them, are unfolded."""
    for name in ("bbox_area", "merge_regions", "region_buckets", "region_viewport", "merge_regions_auto", "merge_regions_exact", "cells_last_writer"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode(split(when" not in plan.lower() and "posexplode(split(case" not in plan.lower(), name
        assert plan.count("Generate") <= 4, name
