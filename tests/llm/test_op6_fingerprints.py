import hashlib
import random

import numpy as np
import pyarrow as pa

from tests.llm.util import alnum, documents, save
from vellum.llm import fingerprints
from vellum.llm.fingerprints import Sketch, sketch_column
from vellum.llm.kernels import ALNUM, Words, shingle_sets
from vellum.llm.queries import op6


def shingles(t):
    w = alnum(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(n=60):
    rng = random.Random(6)
    texts = [None, "", "a", "é " * 7] + [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 300))) for _ in range(n)] + ["x" * 200_000, "y z " * 30_000]
    return [(i * 7 - 20, t) for i, t in enumerate(texts)]


def check(spark, tmp_path, rows):
    got = {r.doc_id: r for r in op6.query(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, r = t or "", after or "", got[i]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(t), shingles(other)
            assert 0 <= near <= 1 and (near == 1) >= (a == b)
            if len(a | b) > 200:
                assert abs(near - len(a & b) / len(a | b)) < 0.15
        assert (r.fingerprint == r.edited_fingerprint) >= (t == edited)


def test_query(spark, tmp_path, monkeypatch):
    check(spark, tmp_path, corpus())
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)  # many ranges
    check(spark, tmp_path, corpus())
    check(spark, tmp_path, [(1, "only one document here of some words")])


def test_repeats_and_nulls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, None), (None, "d"), (9, "e")]
    got = op6.query(spark, save(spark, tmp_path, documents=documents(spark, []).sparkSession.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.with_edits(empty).count() == 0


def test_sketch():
    a, b, whole = sketch_column(__import__("pyarrow").array([" ".join(f"w{i}" for i in range(k, n)) for k, n in ((0, 3000), (2900, 9000), (0, 9000))]))
    assert Sketch.parse(a.text()).text() == a.text()
    assert abs(a.containment(whole) - 1) < 0.02 and abs(whole.containment(a) - 1 / 3) < 0.05
    assert abs(len(a.merge(b)) - len(whole.kept)) <= 20  # a union's sketch, but for the shingles at the joint
    assert a.likeness(a) == 1 and sketch_column(__import__("pyarrow").array(["", None]))[0].text() == sketch_column(__import__("pyarrow").array(["!"]))[0].text()


def test_fingerprints_keep_columns(spark):
    docs = documents(spark, ["a", None]).withColumnRenamed("lang", "fingerprint")
    assert fingerprints.fingerprints(docs).columns == [*docs.columns, "_fingerprint"]


def test_kept_hashes_by_brute_force():
    """A sketch keeps the hashes under the fraction of every shingle, each hashed alone; likeness and containment are plain set ratios."""
    texts = [t for _, t in corpus(40)] + ["one two three four five six", "one two three four five seven"]
    made = sketch_column(pa.array(texts, pa.string()))
    kept = []
    for t in texts:
        own = {int(shingle_sets(Words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]), ALNUM), 5)[0][0]) for x in map(" ".join, shingles(t))}
        kept.append({h >> 23 for h in own if h < 1 << 63})
    assert [set(s.kept.tolist()) for s in made] == kept and [s.n for s in made] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(made):
        for j, b in enumerate(made):
            if shingles(texts[i]) != shingles(texts[j]):
                union, both = len(kept[i] | kept[j]), len(kept[i] & kept[j])
                assert a.likeness(b) == (both / union if union else 0.0)
                assert a.containment(b) == (both / len(kept[i]) if kept[i] else 0.0)
            else:
                assert a.likeness(b) == a.containment(b) == 1.0


def test_error_by_length():
    """Root mean square errors by size, as the docstring states them, with some room."""
    for n, most in ((10, 0.2), (20, 0.14), (50, 0.08), (200, 0.045)):
        pairs = []
        for k in range(400):
            words = [f"k{k}n{n}w{i}" for i in range(n + 4)]
            pairs.append((" ".join(words), " ".join(words[: len(words) - n // 10])))
        made = sketch_column(pa.array([t for p in pairs for t in p]))
        errors = [made[2 * k].likeness(made[2 * k + 1]) - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for k, (a, b) in enumerate(pairs)]
        assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < most
