import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.util import alnum, documents, save
from vellum.llm.decontaminate import drop_contaminated, find_contamination, hit_count
from vellum.llm.queries import op1

V = ["Alpha", "beta", "gamma", "delta", "é1", "x"]


def brute(text, items):
    w, hit, ids = alnum(text), set(), set()
    for i, t in items:
        v = alnum(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit.update(range(p, p + n))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def tables(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(V) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 12, 13, 14, 20, 40]))) for i in range(12)] + [(50, None), (51, " ... "), (9, text(20)), (10, text(20))]
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + [None, "", "!!", text(3000)]
    docs += [text(5) + " " + rng.choice(items[:12])[1] + " " + text(100) for _ in range(20)]
    docs += ["q" * 5 + f" {items[5][1]} " + " ".join(f"u{k}" for k in range(600)), items[3][1].upper()]
    docs += [docs[0], docs[-1]]
    return docs, items


def test_query(spark, tmp_path):
    docs, items = tables(spark)
    d = save(spark, tmp_path, documents=documents(spark, docs), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in op1.query(spark, d).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(docs)}


def test_blocks_and_names(spark):
    docs, items = tables(spark)
    frame = documents(spark, docs).withColumnsRenamed({"lang": "contamination", "source": "items"})
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    one, name = find_contamination(frame, bench)
    many, _ = find_contamination(frame, bench, block_bytes=300)  # several passes
    assert name == "_contamination"
    key = lambda f: sorted((r.doc_id, r[name].n_words, r[name].ranges, r[name]["items"]) for r in f.collect())
    assert key(one) == key(many)
    kept = drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(docs) if not brute(t, items)[-1]}


def test_long_text_and_repeats(spark):
    """A text of many slices, its hits far apart, and copies of it, in one block and in many."""
    item = " ".join(f"b{i}" for i in range(20))
    text = ("pad " * 400_000) + item + (" pad" * 100_000) + " " + item
    docs = documents(spark, [(1, text), (1, text), (2, text), (3, None)])
    bench = spark.createDataFrame([(1, item), (2, " ".join(f"b{i}" for i in range(5, 19))), (3, "other words " * 50)], "item_id long, text string")
    for size in (1 << 20, 200):
        marked, name = find_contamination(docs, bench, block_bytes=size)
        got = sorted((r.doc_id, r[name].n_words, tuple(r[name].ranges), tuple(r[name]["items"])) for r in marked.collect())
        assert got == [(i, 500_040, (400_000, 400_020, 500_020, 500_040), ("1", "2")) for i in (1, 1, 2)] + [(3, 0, (), ())]


def test_empty(spark):
    docs, bench = documents(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    marked, name = find_contamination(docs, bench)
    assert [r[0] for r in marked.select(hit_count(name)).collect()] == [0, 0]
    assert find_contamination(docs.where("false"), bench)[0].count() == 0
    assert drop_contaminated(docs, spark.createDataFrame([(1, "A b")], "item_id long, text string")).select(F.col("doc_id")).collect()[0][0] == 1
