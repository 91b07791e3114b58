import itertools
import random

import pytest

from tests.llm.util import documents, save, words
from vellum.llm import graph, near_dups
from vellum.llm.queries import op4


def brute(rows, n=4):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    rows = [None, "", "  ", "one", "ONE", "one two three", "one two three"]
    for _ in range(25):
        text = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 8)):  # chains: each copy is edited from the one before
            rows.append(" ".join(text))
            if rng.random() < 0.7:
                text = list(text)
                for _ in range(rng.randint(0, max(1, len(text) // 25))):
                    text[rng.randrange(len(text))] = word()
    passage = [word() for _ in range(60)]
    rows += [" ".join(passage + [word() for _ in range(rng.randint(20, 90))]) for _ in range(60)]  # alike, but not alike enough
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tmp_path, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(near_dups, "STAR", 2)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op4.query(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()}
    assert got == brute(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, x) for x in range(501, 560)]
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {}
    for x in {x for e in edges for x in e}:
        seen, left = {x}, [x]
        while left:
            at = left.pop()
            for a, b in edges:
                for u, v in ((a, b), (b, a)):
                    if u == at and v not in seen:
                        seen.add(v)
                        left.append(v)
        root[x] = min(seen)
    got = dict(map(tuple, graph.components(frame).collect()))
    assert got == root and got[340] == 300 and got[559] == 500
    rng.shuffle(edges)
    parts = [spark.createDataFrame(edges[k::2], "a long, b long") for k in (0, 1)]
    assert dict(map(tuple, graph.joined_components(graph.components(parts[0]), parts[1]).collect())) == root


def test_repeated_rows_and_columns(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x y"), (4, None)]).withColumnRenamed("lang", "near_id")
    nameless = docs.unionByName(documents(docs.sparkSession, [(None, "a b c d e f")]).withColumnRenamed("lang", "near_id"))
    kept = near_dups.keep_one_of_each(nameless)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]
    groups = near_dups.near_duplicate_groups(docs)
    assert sorted((r.doc_id, r.component_id) for r in groups.collect()) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]
    assert near_dups.near_duplicate_groups(docs.where("false")).count() == 0


def test_short_sets(spark):
    """No link between small sets is lost to a collision of signature bins: 12 of 15 and 8 of 10 shingles shared."""
    rows = []
    for k in range(6000):
        long, short = ((19, 16), (14, 12))[k % 2]
        text = [f"k{k}w{i}" for i in range(long)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:short]))]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicate_groups(documents(spark, rows)).collect()}
    assert [i for i in got if got[i] != i - i % 2] == []


def test_shared_ids(spark):
    """Different texts under one id are documents of their own."""
    texts = ["a b c d e f", "p q r s t u v", "k l m n o", "P q  r s t u v"]
    docs = documents(spark, [(1, texts[0]), (1, texts[1]), (1, texts[3]), (1, texts[1]), (2, texts[2]), (3, texts[0]), (3, "x y z"), (4, texts[2]), (None, texts[2])])
    got = sorted((r.doc_id or 0, r.text.lower().replace("  ", " ")) for r in near_dups.keep_one_of_each(docs).collect())
    assert got == [(0, texts[2]), (1, texts[0]), (1, texts[1]), (2, texts[2]), (3, "x y z")]


def test_open_buckets(spark):
    """Links between texts that share most of their words with hundreds of others, none of these close enough."""
    rng = random.Random(5)
    rows, planted = [], {}
    for share in (40, 56, 68):  # words of 80 that all texts of a sea share
        common = [f"c{share}x{i}" for i in range(share)]
        for k in range(300):
            own = [f"s{share}k{k}w{i}" for i in range(80 - share)]
            rows.append((len(rows), " ".join(common + own)))
            if k % 6 == 0:  # a copy, two words of its own part changed
                copy = list(own)
                for at in rng.sample(range(len(own)), 2 if share < 60 else 1):
                    copy[at] = f"new{len(rows)}"
                planted[len(rows)] = len(rows) - 1
                rows.append((len(rows), " ".join(common + copy)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    docs = [(order[i], t) for i, t in rows]
    want = brute(docs)
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicate_groups(documents(spark, docs), shingle=4).collect()}
    linked = [i for i in want if want[i][1] != i]
    assert len(linked) >= 100
    assert [i for i in want if got[i] != want[i][1]] == []


def test_long_text_and_one_id(spark):
    """A text of 200,000 words and its copy with a word changed; texts of their own under one id."""
    rng = random.Random(6)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(200_000)]
    other = [*long[:1000], "changed", *long[1001:]]
    docs = documents(spark, [(7, " ".join(long)), (3, " ".join(other)), (5, "a b c d e f g"), (5, "p q r s t u v"), (9, "p q r s t u v"), (None, None)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in near_dups.near_duplicate_groups(docs).collect() if r.doc_id)
    assert [(i, c) for i, _, c in got] == [(3, 3), (5, 5), (5, 5), (7, 3), (9, 5)]


@pytest.mark.parametrize("block", [1024, 40])
def test_one_link_into_a_large_component(spark, monkeypatch, block):
    """Texts that are linked with a single one of 1,001 near copies, and resemble all of them: none is lost; others are not close enough."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(7)
    base = [f"b{i}" for i in range(160)]
    rows, want = [], []

    def add(edits, alone):
        rows.append(" ".join(edits.get(i, w) for i, w in enumerate(base)))
        want.append(len(rows) - 1 if alone else 0)

    near = [{8 * v + 2: f"v{v}" for v in c} for c in itertools.combinations(range(14), 4)]
    for edits in near:
        add(edits, False)
    for k in range(160):  # four more words changed, or six
        own = rng.sample(range(20), 4 if k % 2 else 6)
        add(rng.choice(near) | {8 * x + 6: f"k{k}w{x}" for x in own}, k % 2 == 0)
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicate_groups(documents(spark, rows), shingle=4).collect()}
    assert [i for i in got if got[i] != want[i]] == []
