import random

import numpy as np

from tests.llm.util import DOCS, documents, save, words
from vellum.llm import mixing
from vellum.llm.queries import op5


def corpus(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "w"]) if rng.random() < 0.05 else " ".join("w" for _ in range(rng.randint(1, 400))), "en", rng.choice(["a", "a", "a", "b", "c", "d", "é", None]), 0) for i in range(n)]
    rows += [(n, "w " * 20_000, "en", "b", 0), (n + 1, "w", "en", "tiny", 0), (n + 2, "", "en", "empty", 0), rows[3], rows[3]]
    return spark.createDataFrame(rows, DOCS), rows


def targets(sizes):
    """The contract's law by plain iteration."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    fixed, total = {}, sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[i] for i in free)
        out = {i: left * weights[i] / w for i in free}
        above = [i for i in free if out[i] > 3 * sizes[i]]
        if not above:
            return [fixed.get(i, out.get(i)) for i in range(len(sizes))]
        fixed |= {i: 3 * sizes[i] for i in above}


def test_query(spark, tmp_path):
    frame, rows = corpus(spark)
    d = save(spark, tmp_path, documents=frame)
    got = op5.query(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, op5.query(spark, d).collect()))  # reruns agree
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([size[s] for s in order])))
    source = {r[0]: r[3] for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert sorted(r.size for r in got) == sorted(len(words(r[1])) for r in rows)
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(3 * mixing.BLOCK, 0.02 * goal[s]), (s, taken[s], goal[s])


def test_mixture_and_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    monkeypatch.setattr(mixing, "GROUP_ROWS", 40)
    monkeypatch.setattr(mixing, "RUN", 7)
    monkeypatch.setattr(mixing, "STRATUM_SLOTS", 150)  # several strata
    made = mixing.mix(corpus(spark)[0])
    slots = made.slots().collect()
    assert len({(r.source_no, r.slot) for r in slots}) == len(slots) == sum(made.source_slots)
    shards = {}
    for r in slots:
        shards[r.shard] = shards.get(r.shard, 0) + 1
    assert sorted(shards) == list(range(len(shards))) and len(shards) > 6 and max(shards.values()) <= 50 + len(made.sources)
    for s, own in enumerate(made.sources):  # in each epoch each block comes once at most
        for epoch in range(3):
            blocks = [r.block for r in slots if r.source_no == s and r.epoch == epoch]
            assert len(blocks) == len(set(blocks)) <= own["blocks"] and all(0 <= b < own["blocks"] for b in blocks)
    segments = made.segments().collect()
    assert max(sum(r.n_words for r in segments if (r.source_no, r.block) == key) for key in {(r.source_no, r.block) for r in segments}) <= mixing.BLOCK
    words_of = {}
    for r in made.mixture().collect():
        words_of[r.doc] = words_of.get(r.doc, 0) + r.n_words
    assert words_of == {r.doc: r.taken for r in made.taken().collect() if r.taken}
    counts = mixing.shard_counts([1000, 500, 3], 16, [1, 0])
    assert counts.sum(axis=0).tolist() == [1000, 500, 3] and np.ptp(counts.sum(axis=1)) <= 1
    # strata take up where the one before ends, whatever their number
    for of in (1, 7):
        runs = sorted(r[1:5:2] + r[4:5] for k in range(of) for r in mixing.stratum_runs(k, of, [1000, 500, 3], [400, 500, 1], 30, 1))
        for s, n in enumerate((1000, 500, 3)):
            own = [(a, b) for source, a, b in runs if source == s]
            assert own[0][0] == 0 and own[-1][1] == n - 1 and all(x[1] + 1 == y[0] for x, y in zip(own, own[1:]))


def test_documents(spark):
    frame, rows = corpus(spark)
    got = mixing.mixed_documents(frame)
    assert got.columns == frame.columns
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in rows}
    empty = documents(spark, []).where("false")
    assert mixing.mix(empty).taken().count() == 0 and mixing.mixed_documents(empty).count() == 0
    clash = documents(spark, ["a b", None, (None, "c")]).withColumnsRenamed({"lang": "size", "n_chars": "_copies"})
    assert mixing.mixed_documents(clash).columns == clash.columns


def test_documents_by_law(spark):
    """Copies of each document from the words taken and the seeded draw, and each source's words near its target."""
    frame, rows = corpus(spark)
    made = mixing.mix(frame).taken().collect()
    of_id = {}
    for r in made:
        t, n = of_id.get(r.doc_id, (0, 0))
        of_id[r.doc_id] = (t + r.taken, n + r.size)
    draws = {r[0]: r[1] % (1 << 30) / (1 << 30) for r in frame.selectExpr("doc_id", "xxhash64(doc_id, 20)").collect()}
    want, size = [], {}
    for r in rows:
        taken, n = of_id[r[0]]
        want += [r] * (1 if not n else taken // n + (taken % n / n > draws[r[0]]))
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    got = [tuple(r) for r in mixing.mixed_documents(frame).collect()]
    key = lambda r: (r[0], str(r))
    assert sorted(got, key=key) == sorted(want, key=key)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, targets([size[s] for s in order])):
        mine = [r for r in rows if r[3] == s]
        total = sum(len(words(r[1])) for r in got if r[3] == s)
        # drawing last parts moves a source by half of a document's words each, in the root of squares
        noise = sum((len(words(r[1])) / 2) ** 2 for r in mine) ** 0.5
        assert abs(total - goal) <= 4 * noise + max(3 * mixing.BLOCK, 0.02 * goal), (s, total, goal)
