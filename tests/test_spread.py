"""Operators along a key in blocks: anchors, running sums, neighbours, overlaps; keys of very many rows spread."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import anchors, bins, geometry, grouping, running
from vellum.sources import views


def chain(values, reach=8.0):
    starts = []
    for v in sorted(set(values)):
        if not starts or v - starts[-1] >= reach:
            starts.append(v)
    return starts


@pytest.mark.parametrize("together", [False, True])
def test_anchored_over_blocks(spark, monkeypatch, together):
    """Small blocks: chains run over many of them, some empty, some without an anchor of their own."""
    monkeypatch.setattr(anchors, "BLOCK", 2)
    rng = random.Random(1)
    keys = {k: [rng.choice([rng.randint(-400, 400) / 2, rng.uniform(-90, 90), rng.randint(0, 40) * 100.0]) for _ in range(rng.choice([1, 3, 40, 400]))] for k in range(40)}
    keys[None], keys[99] = [1.0, 9.0, 9.5, 300.0], [0.1 * i for i in range(900)]
    rows = [(k, v) for k, values in keys.items() for v in values] + [(0, None), (77, None)]
    frame = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {}
    for r in anchors.anchored(frame, "k", "v", together=together).collect():
        got.setdefault(r.k, []).append((r.v, r.line_idx))
    assert sum(map(len, got.values())) == len(rows)
    for k, values in keys.items():
        starts = chain(values)
        assert sorted(x for x in got[k] if x[0] is not None) == sorted((v, sum(s <= v for s in starts) - 1) for v in values)
    assert (None, -1) in got[0] and got[77] == [(None, -1)]


def test_one_key_spreads(spark):
    """Ten million positions of one key: no task orders or chains more than a block of them, and the pass over blocks gets a few rows of each."""
    n = 10_000_000
    rows = spark.range(0, n, 1, 16).select(F.lit(1).alias("k"), (F.col("id") * 3.0).alias("v"))
    blocked = rows.withColumn("b", F.floor(F.col("v") / (anchors.REACH * anchors.BLOCK)))
    places = anchors._places(blocked, "k", "v", "b")
    starts = anchors.anchor_starts(places).cache()
    sizes = starts.select(F.count("*").alias("blocks"), F.max(F.size("starts")).alias("most"), F.sum(F.size("starts")).alias("all"), F.max(F.col("before") + F.size("starts")).alias("upto")).first()
    # positions 3 apart: every third one is an anchor
    assert sizes["all"] == sizes["upto"] == -(-n // 3) and sizes.blocks > 3000 and sizes.most <= anchors.BLOCK
    starts.unpersist()


def test_running_sum(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 9)) for k in (1, 2, None) for i in range(500)]
    got = running.running_sum(spark.createDataFrame(rows, "k int, i int, x int"), ["k"], F.floor(F.col("i") / 7), ["i"], F.col("x").cast("long"), "s").collect()
    assert len(got) == 1500 and all(r.s == sum(x for k, i, x in rows if k == r.k and i < r.i) for r in got)


def test_spread_lines_are_the_same(spark, monkeypatch):
    docs = views.table(spark, "/root/testdata/sf0.001", "documents")
    elements = views.elements(docs)
    monkeypatch.setattr(anchors, "BLOCK", 16)
    monkeypatch.setattr(grouping, "LINES", 3)
    for f in (grouping.reading_lines, grouping.spatial_map):
        assert sorted(map(tuple, f(elements).collect())) == sorted(map(tuple, f(elements, together=True).collect()))


def test_neighbours(spark):
    rng = random.Random(3)
    points = sorted({(k, rng.randint(-50, 50) * 40.0) for k in (1, 2) for _ in range(30)}) + [(4, 5.0)]
    queries = [(k, i, rng.choice([rng.uniform(-2100, 2100), rng.choice(points)[1]])) for k in (1, 2, 3, 4) for i in range(60)]
    got = running.neighbours(spark.createDataFrame(points, "k int, at double"), spark.createDataFrame(queries, "k int, q int, at double"), "k", "at", width=100.0).collect()
    assert len(got) == len(queries)
    for r in got:
        own = [v for k, v in points if k == r.k]
        assert (r.before and r.before["at"]) == max((v for v in own if v <= r["at"]), default=None)
        assert (r.after and r.after["at"]) == min((v for v in own if v > r["at"]), default=None)


def test_overlaps(spark):
    rng = random.Random(4)
    box = lambda i: (i, rng.choice([1, 1, 1, 2, None]), rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 3.0, 60.0]), rng.choice([0.0, 5.0, 200.0]))
    left, right = [box(i) for i in range(120)], [box(i) for i in range(80)] + [(99, 1, 0.0, None, 1.0, 1.0), (98, 1, 0.0, 0.0, -1.0, 1.0)]
    boxes = spark.createDataFrame(left, "box int, doc_id int, x double, y double, w double, h double")
    screens = spark.createDataFrame(right, "view_id int, doc_id int, vx double, vy double, vw double, vh double")
    want = {(a[0], b[0]) for a in left for b in right[:80] if a[1] and a[1] == b[1] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]}
    for tile in (7.0, 256.0):
        geometry.TILE = tile
        got = [(r.box, r.view_id) for r in geometry.in_views(boxes, screens).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    spans = [(1, a, a + rng.randint(0, 4)) for a in range(0, 60)]
    marks = [(1, i, a, a + rng.choice([0, 1, 7, 50])) for i, a in enumerate(rng.randint(0, 60) for _ in range(40))]
    frame = grouping.overlapping(spark.createDataFrame(spans, "doc_id int, start_char int, end_char int"), spark.createDataFrame(marks, "doc_id int, sel int, sel_start int, sel_end int"))
    got = [(r.start_char, r.sel) for r in frame.collect()]
    assert sorted(got) == sorted((s, i) for _, s, e in spans for _, i, a, b in marks if a < e and b > s)


def test_far_sides_never_meet(spark):
    """Cells bound what a document's spans and selections are paired with."""
    n = 20_000
    spans = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("a"))
    marks = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("m"), (F.col("id") * 10 + 5).alias("b"))
    pairs = bins.overlap_join(spans, marks, ["k"], [bins.Axis(F.col("a"), F.col("a") + 6, F.col("b"), F.col("b"), 64)])
    assert pairs.count() == n
