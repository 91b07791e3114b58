"""Operators against plain-Python models of the sequential rules, and edge rows."""

import random

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import anchors, edit, geometry, grid, grouping, rope, search
from vellum.sources import readers, views


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("v"))).collect()]


def test_lines(spark):
    assert column(spark, ["", "a", "a\n", "a\r\nb", None], T.text_lines) == [[], ["a"], ["a"], ["a", "b"], None]


def test_sanitise(spark):
    assert column(spark, ["\t", "\r", "\r\n", "a\x07b", "a\x85b"], T.sanitise) == ["    ", "\n", "\n\n", "ab", "ab"]


def test_blocks(spark):
    rows = [["12345", "1234567"], ["12345", "12345678"], ["  a", "  b"], ["  a", " bb"], ["one"], []]
    assert column(spark, rows, T.is_block, "array<string>") == [True, False, True, False, False, False]


def test_tokens_and_numbers(spark):
    lines = ["  5 hello", "100 hello", "hello world", "x"]
    assert column(spark, lines, T.strip_first_token) == [" 5 hello", "hello", "world", "x"]
    assert column(spark, lines, T.strip_line_number) == ["hello", "hello", "hello world", "x"]
    assert column(spark, ["a"], lambda c: T.numbered(c, F.lit(12345))) == ["12345 a"]
    assert column(spark, ["Title\nPages: 12\nPages: 3", "none", "Pages: x"], T.page_count) == [12, None, None]


def test_boxes(spark):
    inside = lambda x, y: spark.range(1).select(geometry.contains(*map(F.lit, (x, y, 10, 5, 20, 15)))).first()[0]
    assert all(inside(x, y) for x, y in ((10, 5), (15, 10), (29, 19)))
    assert not any(inside(x, y) for x, y in ((9, 5), (10, 4), (30, 10), (15, 20)))


def test_blank_grid(spark):
    got = grid.text_grid(spark.createDataFrame([(1, "")], "doc_id long, text string")).first()
    assert (got.width, got.height, got.rows) == (80, 25, [" " * 80] * 25)


def _lines(values):
    """Sequential rule: the first line whose first word is less than 8 away."""
    firsts, out = [], []
    for v in sorted(values):
        for i, f in enumerate(firsts):
            if abs(v - f) < 8:
                out.append((v, i))
                break
        else:
            firsts.append(v)
            out.append((v, len(firsts) - 1))
    return sorted(out)


def test_anchored(spark):
    rng = random.Random(1)
    docs = [[0.0, 5.0, 10.0], [0.0, 8.0], [1.0, 1.0]] + [[rng.randint(0, 120) / 2 for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = [(d, v) for d, values in enumerate(docs) for v in values]
    got = anchors.anchored(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()
    for d, values in enumerate(docs):
        assert sorted((r.v, r.line_idx) for r in got if r.k == d) == _lines(values)


def test_merge(spark):
    rng = random.Random(2)
    rows = []
    for d in range(80):
        xs = [rng.randint(0, 40) for _ in range(rng.randint(1, 15))]
        rows += [(d, 0, i, x, d % 3, chr(97 + i)) for i, x in enumerate(sorted(xs) if d % 2 else xs)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, region_id long, x int, y int, ch string")
    exact, islands = (sorted(map(tuple, f(frame).collect())) for f in (grouping.merge_exact, grouping.merge_islands))
    assert [r for r in exact if r[0] % 2] == [r for r in islands if r[0] % 2]  # in order of x both agree
    for d in range(80):
        left = [[x, x + 1, ch, i] for _, _, i, x, _, ch in (r for r in rows if r[0] == d)]
        want = []
        done = [False] * len(left)
        for i in range(len(left)):
            if done[i]:
                continue
            a, b, t, n = left[i]
            done[i] = grew = True
            while grew:
                grew = False
                for j, (c, e, u, _) in enumerate(left):
                    if not done[j] and (abs(c - b) <= 2 or abs(a - e) <= 2):
                        a, b, t, done[j], grew = min(a, c), max(b, e), t + u, True, True
            want.append((d, 0, d % 3, a, b - a, n, t))
        assert sorted(want) == [r for r in exact if r[0] == d]
    seed = spark.createDataFrame([(0, 0, i, x, 0, "c") for i, x in enumerate((0, 3, 6, 9, 5))], "doc_id long, page int, region_id long, x int, y int, ch string")
    assert sorted(r.width for r in grouping.merge_exact(seed).collect()) == [1, 10]


def test_paint(spark):
    rng = random.Random(3)
    rows = [(d, 0, s, "".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))), 6.0 * rng.randint(0, 3), 12.0 * rng.randint(0, 1), 1.0, rng.choice([10.0, 14.0, 14.5])) for d in range(60) for s in range(6)]
    got = {(r.doc_id, r.y, r.x): r.ch for r in grid.priority_paint(spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, x double, y double, w double, h double")).collect()}
    want = {}
    for d in range(60):
        own = [r for r in rows if r[0] == d]
        mx, my = min(r[4] for r in own), min(r[5] for r in own)
        for r in own:
            for i, ch in enumerate(r[3]):
                cell = (d, int((r[5] - my) / 12), int((r[4] - mx) / 6) + i)
                if want.setdefault(cell, " ") == " " or r[7] > 14:
                    want[cell] = ch
    assert got == want


def test_measures(spark):
    sizes = spark.createDataFrame([(1, 0, float(s), 1) for s in (1, 2, 3, 4)] + [(2, 0, 1.0, 2), (2, 0, 2.0, 2)], "doc_id long, page int, size double, n long")
    assert {r.doc_id: r.median for r in geometry.upper_median(sizes).collect()} == {1: 3.0, 2: 2.0}
    assert {r.doc_id: r.mode for r in geometry.font_mode(sizes).collect()} == {1: 1, 2: 1}


def test_search(spark):
    rows = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "héllo llo"), (1, 2, "x.x")], "doc_id long, row_idx int, text string")
    assert [(r.row_idx, r.col_char) for r in search.find(rows, "aa").collect()] == [(0, 0), (0, 2)]
    assert [(r.col_char, r.col_byte) for r in search.find(rows, "llo").orderBy("col_char").collect()] == [(2, 3), (6, 7)]
    assert search.find(rows, "").count() == 0 and search.find(rows, ".").count() == 1
    hits = search.numbered_hits(search.find(rows, "llo")).orderBy("hit").collect()
    assert [(h.next_col, h.prev_col) for h in hits] == [(6, 6), (2, 2)]


def test_edits(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["abcdef", "ghijkl", "mnopqr"])], "doc_id long, row_idx int, text string")
    grids = spark.createDataFrame([(1, 3)], "doc_id long, height int")
    marks = edit.normalised(spark.createDataFrame([(1, 1, 3, 0, 1)], "doc_id long, r0 int, c0 int, r1 int, c1 int"), grids)
    text = lambda f: [r.text for r in f.orderBy("row_idx").collect()]
    at = lambda r, c: spark.createDataFrame([(1, r, c)], "doc_id long, row int, col int")
    assert edit.copied(rows, marks).first().text == "bcd\nhij"
    assert text(edit.cut_out(rows, marks)) == ["a   ef", "g   kl", "mnopqr"]
    assert text(edit.moved(rows, marks, at(1, 2))) == ["a   ef", "g bcdl", "mnhijr"]  # blank first, then written
    clip = edit.selected_rows(rows, marks, False).select("doc_id", "row_off", "text")
    assert text(edit.pasted(rows, clip, at(2, 4))) == ["abcdef", "ghijkl", "mnopbc"]
    assert text(edit.pasted_growing(rows, clip, at(2, 4), "width")) == ["abcdef", "ghijkl", "mnopbcd", "    hij"]
    wide = lambda c1: edit.normalised(spark.createDataFrame([(1, 0, 0, 0, c1)], "doc_id long, r0 int, c0 int, r1 int, c1 int"), grids)
    assert edit.copied(rows, wide(99_999)).first().text == "abcdef" and edit.copied(rows, wide(100_000)).first().text == edit.TOO_LARGE
    keys = spark.createDataFrame([(1, 0, 7, "z")], "doc_id long, row_idx int, col int, ch string")
    assert text(edit.typed(rows, keys, True))[0] == "abcdef z" and text(edit.typed(rows, keys, False))[0] == "abcdef"
    edits = spark.createDataFrame([(1, 1, "insert", 0, 0, "hello"), (1, 2, "replace", 0, 1, "J"), (1, 3, "delete", 4, 5, ""), (1, 4, "delete", 3, 9, ""), (1, 5, "insert", 4, 0, "y")], "doc_id long, seq long, op string, start long, end long, piece string")
    assert rope.replayed_text(edits).first().text == "Jelly"


def test_alto(spark):
    xml = '<alto><String CONTENT="out" HPOS="1"/><Page id="1"><String CONTENT="a&amp;b" HPOS="x" VPOS="2.5"/><String CONTENT="" HPOS="1"/><String HPOS="3" CONTENT="c>d" WIDTH="7"/></Page></alto>'
    got = readers.alto_elements(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).orderBy("ord").collect()
    assert [(r.content, r.hpos, r.vpos, r.width) for r in got] == [("a&amp;b", 0.0, 2.5, 0.0), ("c>d", 3.0, 0.0, 7.0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert grouping.reading_lines(views.elements(docs)).count() == 0
    assert grid.grid_rows(grid.text_grid(docs)).count() == 0
    assert geometry.grid_size(views.segments(docs)).count() == 0


def test_rejection(spark):
    paths = ["/a/b.pdf", "/a/.pdf", "/a/pdf", "pdf", "x.PDF", "/a.pdf/b", "..pdf", "/a/b.pdf/", "a.b.pdf"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(readers.rejection(F.lit(True), F.lit(True), F.col("p"))).collect()
    assert [r[0] is None for r in rows] == [True, False, False, False, False, False, True, True, True]


def test_pasted_text(spark):
    """A block loses its indent; plain lines stay; nothing becomes a space; rows below come 80 wide."""
    docs = spark.createDataFrame([(1, "  ab\n  cd"), (2, " a\nbcd"), (3, ""), (4, "\t")], "doc_id long, t string").withColumn("text", F.lit("abc"))
    grids = grid.text_grid(docs, keep=("t",))
    rows = edit.pasted_text(grids, F.col("t"), F.lit(24), F.lit(1)).where("row_idx >= 24").orderBy("doc_id", "row_idx").collect()
    assert [(r.doc_id, r.text.rstrip(), len(r.text)) for r in rows] == [(1, " ab", 3), (1, " cd", 80), (2, "  a", 3), (2, " bcd", 80), (3, "", 3), (4, "", 5)]


def test_glyph_offsets(spark):
    """Offsets of lines longer than a block of pieces, by plain splitting."""
    rng = random.Random(7)
    texts = [" ".join("x" * rng.randint(0, 5) for _ in range(n)) for n in (0, 1, 63, 64, 65, 129, 700)]
    got = views.words(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        want, at = [], 0
        for j, w in enumerate(t.split(" ")):
            want.append((j, at, w))
            at += len(w) + 1
        assert sorted((r.j, r.off, r.content) for r in got if r.doc_id == i) == want
