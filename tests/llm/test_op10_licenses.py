import random

import numpy as np
import pyarrow as pa

from tests.llm.util import alnum, documents, save
from vellum.llm import licenses
from vellum.llm.kernels import ALNUM, Words, slices
from vellum.llm.queries import op10

BY_LABEL = {}
for label, text in licenses.TEMPLATES:
    BY_LABEL.setdefault(label, []).append(text)
PHRASES = [(alnum(p), label) for p, label in licenses.PHRASES]


def brute(text):
    w = alnum(text)
    return len(w), sorted((i, label) for p, label in PHRASES for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)


def texts():
    rng = random.Random(3)
    whole = [alnum(t) for _, t in licenses.TEMPLATES]
    out = [None, "", "CC-BY/NC", "é under the MIT\nlicense: under the mit license", "word " * 40_000 + "cc by nc"]
    for _ in range(400):
        w = []
        for _ in range(rng.randint(0, 10)):
            kind = rng.random()
            if kind < 0.4:
                w += rng.choice(PHRASES)[0]
            elif kind < 0.6:
                t = rng.choice(whole)
                i = rng.randrange(len(t))
                w += t[i : i + rng.randint(1, 30)]
            else:
                w.append(rng.choice(["x", "under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2"]))
        out.append(" ".join(w))
    return out


def test_query(spark, tmp_path):
    rows = texts() + [BY_LABEL["mit"][0], "before " + BY_LABEL["gpl-3"][1] + " after", BY_LABEL["apache-2"][0][:80]]
    rows += rows[-3:-1]  # repeated rows
    got = {r.doc_id: r for r in op10.query(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()}
    for i, t in enumerate(rows):
        n, places = brute(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = sorted({label for _, label in places})
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert [got[len(rows) - k].labels for k in (5, 4, 2, 1)] == ["mit", "gpl-3"] * 2 and got[len(rows) - 5].score == 1


def test_matching_statistics():
    scanner = licenses._scanner()
    seqs = [licenses.word_hashes(t).tolist() for t in [t for _, t in licenses.TEMPLATES] + [p for p, _ in licenses.PHRASES]]
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, min(len(s), i + 60) + 1)}
    for text in texts()[5:60]:
        hashes = licenses.word_hashes(text).tolist()
        code = [int(np.searchsorted(scanner.vocabulary, np.uint64(h))) if (scanner.vocabulary == np.uint64(h)).any() else -1 for h in hashes]
        state = length = 0
        for i, c in enumerate(code):
            state, length = scanner.automaton.step(state, length, c)
            assert length == max((n for n in range(min(i + 1, 60) + 1) if not n or tuple(hashes[i + 1 - n : i + 1]) in runs))


def test_spans_and_columns(spark):
    body = " ".join(alnum(BY_LABEL["bsd-2"][0]))
    for _, _, b, o in slices(pa.array(["zz " + body + " zz"])):
        (_, spans), = licenses._scanner().scan(Words(b, o, ALNUM)).values()
    template, first, end, covered, stands = spans[0]
    assert (licenses.TEMPLATES[template][0], first, end, covered, stands) == ("bsd-2", 1, 1 + len(body.split()), 1.0, True)
    docs = documents(spark, ["a", None]).withColumnRenamed("lang", "licenses")
    found, name = licenses.scan_licenses(docs)
    assert found.columns == [*docs.columns, "_licenses"] and found.count() == 2 and licenses.scan_licenses(docs.where("false"))[0].count() == 0


def test_shared_runs(spark, tmp_path):
    """A run counts at all its places: in every template that has it, and wherever a template repeats it."""
    bsd = alnum(BY_LABEL["bsd-2"][0])
    again = "copyright notice this list of conditions and the following disclaimer".split()
    places = [i for i in range(len(bsd)) if bsd[i : i + len(again)] == again]
    assert len(places) == 2
    rows = [" ".join(bsd), " ".join(again), " ".join([" ".join(again), "x"] * 2), "zz ".join([BY_LABEL["cc-by-nc"][0] + " "] * 3)]
    got = {r.doc_id: r for r in op10.query(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()}
    assert [got[i].score for i in (0, 1, 2)] == [n / len(bsd) for n in (len(bsd), len(again), 2 * len(again))]
    assert [got[i].labels for i in range(4)] == ["bsd-2", "", "", "cc-by-nc"] and got[3].score == 1
    scanner = licenses._scanner()
    seqs = [licenses.word_hashes(t).tolist() for _, t in licenses.TEMPLATES]
    for text in texts()[5:60]:  # maximal runs by plain comparison
        w = licenses.word_hashes(text).tolist()
        want = set()
        for t, s in enumerate(seqs):
            for i in range(len(w)):
                for f in range(len(s)):
                    if w[i] == s[f] and (i == 0 or f == 0 or w[i - 1] != s[f - 1]):
                        n = 1
                        while i + n < len(w) and f + n < len(s) and w[i + n] == s[f + n]:
                            n += 1
                        if n >= licenses.CHAIN_WORDS:
                            want.add((i, n, t, f))
        code = [int(np.searchsorted(scanner.vocabulary, np.uint64(h))) if (scanner.vocabulary == np.uint64(h)).any() else -1 for h in w]
        assert sorted(scanner.read(code)[1]) == sorted(want)


def best_words(w, t):
    """Words of w that the best chain of template t explains, trying every run and every run before it."""
    runs = []
    for i in range(len(w)):
        for f in range(len(t)):
            if w[i] == t[f] and (i == 0 or f == 0 or w[i - 1] != t[f - 1]):
                n = 1
                while i + n < len(w) and f + n < len(t) and w[i + n] == t[f + n]:
                    n += 1
                if n >= licenses.CHAIN_WORDS:
                    runs.append((i, n, f))
    best = {}
    for i, n, f in sorted(runs, key=lambda r: (r[0] + r[1], r)):
        best[i, n, f] = n
        for (j, m, g), words in list(best.items()):
            if (j, m, g) != (i, n, f) and i - j - m <= licenses.GAP and j + m <= i + n:
                both = max(0, j + m - i, g + m - f)
                if both < n:
                    best[i, n, f] = max(best[i, n, f], words + n - both)
    return max(best.values(), default=0)


def test_chains_by_brute_force():
    """The first chain of random splices explains as many words as the best chain of any template by an O(n m) matcher."""
    rng = random.Random(11)
    scanner = licenses._scanner()
    whole = [alnum(t) for _, t in licenses.TEMPLATES]
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(whole)
            i = rng.randrange(len(t))
            w += t[i : i + rng.randint(4, 40)] + ["zz"] * rng.randint(0, 15)
        body = np.frombuffer(" ".join(w).encode(), np.uint8)
        found = scanner.scan(Words(body, np.array([0, len(body)]), ALNUM))
        spans = found[0][1] if found else []
        want = [best_words(w, t) for t in whole]
        if max(want):
            assert max(round(c * len(whole[t])) for t, _, _, c, _ in spans) == max(want)
        else:
            assert not spans
        for t, first, end, covered, stands in spans:
            assert covered * len(whole[t]) <= want[t] + 1e-6 and first < end <= len(w)


def test_rivals(spark, tmp_path):
    """A label needs words that tell it from licenses that share the rest."""
    work = "This work is licensed under a Creative Commons "
    rows = {
        work + "Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        work + "Attribution 3.0 Unported License": "cc-by",
        work + "Attribution 3.0": "cc-by",
        work + "Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd",
        work + "Attribution-Something 9.0": "",  # as much of one as of the others
        work: "",
    }
    rows |= {text: label for label, own in BY_LABEL.items() for text in own}
    got = {r.doc_id: r.labels for r in op10.query(spark, save(spark, tmp_path, documents=documents(spark, list(rows)))).collect()}
    base = {"apache-2": "apache-2"}
    assert {t: got[i] for i, t in enumerate(rows)} == {t: base.get(label, label) for t, label in rows.items()}
