import random

import numpy as np
import pytest

from vellum.operators import rope
from vellum.operators.edit import apply_edit

SCHEMA = "doc_id long, seq long, op string, start long, end long, piece string"


def replay(rows, texts=()):
    out = {d: t or "" for d, t in texts}
    for d, _, op, start, end, piece in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] if r[3] is not None else 0)):
        out.setdefault(d, "")
        if start is not None and (end is not None or op == "insert"):
            out[d] = apply_edit(out[d], op, start, end, piece or "")
    return out


def edits(rng, doc, n, reach=12):
    letters = "abcé漢🙂 "
    return [(doc, i * 3 + 1, rng.choice(["insert", "insert", "delete", "replace", "other"]), rng.randint(-1, reach), rng.randint(0, reach + 4), "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))) for i in range(n)]


def got(frame):
    rows = frame.collect()
    out = {r.doc_id: r.text for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("part", [3, 16, 4096])
def test_against_the_sequential_rule(spark, part):
    rng = random.Random(part)
    rows = [e for d in range(40) for e in edits(rng, d if d else None, rng.choice([1, 2, 17, 60, 150]))]
    rows += [(50, 1, "insert", 0, None, "abc"), (50, 2, "delete", None, 2, None), (50, 3, None, 0, 1, "x"), (50, 4, "replace", 1, 2, None), (51, 1, "delete", 0, 1, None), (52, 5, "insert", 0, 0, "")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(rope.replayed_text(frame, part=part)) == replay(rows)
    texts = [(d, "".join(rng.choice("xyzé🙂") for _ in range(rng.choice([0, 1, 30, 300])))) for d in range(1, 60, 2)] + [(70, None)]
    assert got(rope.replayed_text(frame, spark.createDataFrame(texts, "doc_id long, text string"), part=part)) == replay(rows, texts)


def test_no_edits(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(rope.replayed_text(none)) == {}
    assert got(rope.replayed_text(none, spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string"))) == {1: "a", None: ""}


def test_one_document_of_very_many_edits(spark):
    """Its edits lie in many parts, which are composed on several tasks; a list that is edited in place gives the same text."""
    rng = random.Random(9)
    n, text, rows = 200_000, [], []
    for i in range(n):
        at = rng.randint(0, len(text))
        if rng.random() < 0.75 or not text:
            rows.append((7, i, "insert", at, 0, f"{i % 10}é"))
            text[at:at] = rows[-1][5]
        else:
            end = min(len(text), at + 3)
            rows.append((7, i, "replace", at, end + (at > len(text) - 2), "-"))
            if rows[-1][4] <= len(text):
                text[at : rows[-1][4]] = "-"
    frame = spark.createDataFrame(rows, SCHEMA)
    parts = rope._parts(frame, rope.PART)
    assert parts.count() > 20 and max(r[0] for r in parts.selectExpr("size(op)").collect()) <= rope.PART
    assert got(rope.replayed_text(frame)) == {7: "".join(text)}


def test_composition_is_associative():
    """However edits are grouped, the script is the same one."""
    rng = random.Random(4)
    for _ in range(100):
        length, n = rng.randint(0, 20), rng.randint(2, 9)
        of, src, size, place, long = [], [], [], 0, length
        for i in range(n):
            a = rng.randint(0, long)
            b = rng.randint(a, long)
            put = rng.randint(0, 4)
            of += [i] * 3
            src += [0, -1 - place, b]
            size += [a, put, long - b]
            place, long = place + put, long + put - (b - a)
        scripts = rope.Scripts(*map(np.array, (of, src, size)))
        whole = scripts.composed(np.array([n]))
        k = rng.randint(1, n - 1)
        halves = scripts.composed(np.array([k, n - k]))
        both = halves.composed(np.array([2]))
        assert (whole.src.tolist(), whole.size.tolist()) == (both.src.tolist(), both.size.tolist()) and whole.size.sum() == long
