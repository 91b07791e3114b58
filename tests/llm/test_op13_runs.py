import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import NONSPACE, documents, save
from vellum.llm.queries import op13
from vellum.llm.runs import find_runs, run_column, with_runs


def brute(words, least=24, times=3):
    """Runs (start, length, period), by comparing each word with the one a period later."""
    best = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda x: (x[0], x[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(words, key):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row(key, text):
    words = periodic(NONSPACE.findall(text or ""), key)
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs)))


def pieces(rng):
    """Texts of repeats of repeats, broken here and there."""
    out = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 40]))]
        if rng.random() < 0.4:
            unit = unit * rng.randint(1, 5) + [rng.choice("abd")]
        out += unit * rng.randint(1, 9)
        if rng.random() < 0.5:
            out[rng.randrange(len(out))] = rng.choice("abx")
    return out


def test_against_brute_force():
    rng = random.Random(13)
    rows = [pieces(rng) for _ in range(150)] + [["a"] * n for n in (0, 1, 23, 24, 25, 500)] + [[rng.choice("ab") for _ in range(400)] for _ in range(8)]
    for least in (24, 3, 10):
        words = np.array([ord(w) for r in rows for w in r], np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        start, length, period = find_runs(words, bounds, least)
        of = np.searchsorted(bounds, start, side="right") - 1
        got = [[] for _ in rows]
        for i, s, n, p in zip(of.tolist(), (start - bounds[of]).tolist(), length.tolist(), period.tolist()):
            got[i].append((s, n, p))
        assert got == [brute(r, least) for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é漢\t\n\x1f\x0b", max_size=60), st.integers(1, 30).map(lambda n: "é b\t" * n)), max_size=6))
def test_any_text(texts):
    got = run_column(pa.array(texts, pa.string())).to_pylist()
    words = [NONSPACE.findall(t or "") for t in texts]
    assert [g["n_words"] for g in got] == [len(w) for w in words]
    runs = [[(r["start"], r["length"], r["period"]) for r in g["runs"]] for g in got]
    assert runs == [brute(w) for w in words]
    assert [g["collapsed"] for g in got] == [collapsed(w, r) for w, r in zip(words, runs)]


def test_blocks(monkeypatch):
    """Small blocks and slices give what large ones give."""
    from vellum.llm import kernels, runs

    rng = random.Random(5)
    texts = [" ".join(pieces(rng)) for _ in range(200)]
    whole = run_column(pa.array(texts)).to_pylist()
    monkeypatch.setattr(runs, "BLOCK", 50)
    assert run_column(pa.array(texts)).to_pylist() == whole
    monkeypatch.setattr(kernels.slices, "__defaults__", (40,))
    assert run_column(pa.array(texts)).to_pylist() == whole


def test_long_texts():
    """A million words of one, of a long period, and of none: all in a few seconds, as known runs are skipped."""
    rng = random.Random(1)
    unit = [str(rng.randrange(5000)) for _ in range(70_000)]
    assert brute_free(["x"] * 1_000_000) == [(0, 1_000_000, 1)]
    assert brute_free(unit * 4 + ["end"]) == [(0, 280_000, 70_000)]
    assert brute_free(["a", "b", "a", "c"] * 20_000) == [(0, 80_000, 4)]


def brute_free(words):
    (got,) = run_column(pa.array([" ".join(words)])).to_pylist()
    return [(r["start"], r["length"], r["period"]) for r in got["runs"]]


def test_query(spark, tmp_path):
    rng = random.Random(3)
    texts = [(i, " ".join(pieces(rng))) for i in range(250)] + [(None, "a " * 40), (7, None), (7, ""), (20, " \n"), (10**12, "x y " * 30), (5, "z " * 50), (5, "z " * 50)]
    texts += [(1000 + i, " ".join(str(rng.randrange(40)) for _ in range(200))) for i in range(60)]
    frame = op13.query(spark, save(spark, tmp_path, documents=documents(spark, texts)))
    assert frame.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in frame.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted((row(*t) for t in texts), key=repr)
    assert sum(periodic(list(range(50)), i) != list(range(50)) for i, _ in texts if i is not None) > 20


def test_names_and_empty(spark):
    docs = documents(spark, ["a " * 30, None]).withColumnsRenamed({"lang": "Repeats", "source": "runs"})
    made, name = with_runs(docs)
    assert name == "_repeats" and made.columns == [*docs.columns, name]
    assert sorted((len(r[name].runs), r[name].collapsed) for r in made.collect()) == [(0, ""), (1, "a")]
    assert with_runs(docs.where("false"))[0].count() == 0
