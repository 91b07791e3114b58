import math
import random

import numpy as np

from tests.llm.util import DOCS, documents, save
from vellum.llm.classify import classify, document_terms, keep_fit, train
from vellum.llm.kernels import ALNUM, Words
from vellum.llm.queries import op9

SF = "/root/testdata/sf0.01"


def corpus(spark, n=1500, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        low, toxic = rng.random() < 0.2, rng.random() < 0.15
        w = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(20, 120))]
        if low:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["awfulx", "nastyy", "grimmzz", "stemm" + rng.choice("abc")])
        rows.append((i, " ".join(w), "en", rng.choice(["a", "a", "b", None]), 0))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(rows, DOCS), labels


def test_held_out(spark, tmp_path):
    docs, labels = corpus(spark)
    known = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    d = save(spark, tmp_path, documents=docs, labels=known)
    got = {r.doc_id: r for r in op9.query(spark, d).collect()}
    assert len(got) == 1500
    wrong = [i for i, q, t in labels[1000:] if got[i].kept != (q == 1 and t == 0)]
    assert len(wrong) <= 15, len(wrong)


def test_test_tables(spark):
    labels = spark.read.parquet(SF + "/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    made, name = classify(spark.read.parquet(SF + "/documents.parquet"), half)
    rows = made.join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("quality", "toxic", f"{name}.rejected AS r").collect()
    clean, bad = [r.r for r in rows if r.quality == 1 and r.toxic == 0], [r.r for r in rows if r.quality == 0]
    assert sum(clean) <= 0.03 * len(clean) and sum(bad) >= 0.85 * len(bad)


def test_sites_shrink(spark):
    """A bad host of many rows moves its documents' odds, one of a single row hardly does."""
    docs, labels = corpus(spark, 600)
    flat = docs.selectExpr("doc_id", "text", "lang", "'good' AS source", "n_chars")
    bad = docs.join(spark.createDataFrame(labels, "doc_id long, q int, t int").where("q = 0").select("doc_id"), "doc_id")
    bad = bad.selectExpr("doc_id + 10000", "text", "lang", "'bad' AS source", "n_chars")
    one = bad.limit(1).selectExpr("`(doc_id + 10000)` + 50000", "text", "lang", "'single' AS source", "n_chars")
    made, name = classify(flat.union(bad).union(one).toDF(*docs.columns), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rates = {r.source: r.h for r in made.selectExpr("source", f"{name}.host_rate AS h").distinct().collect()}
    assert rates["good"] < rates["single"] < rates["bad"]


def test_edges(spark):
    docs = documents(spark, [None, "", "a b c", "a b c", "!" * 5000, "x " * 50_000]).withColumnRenamed("n_chars", "evidence")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert keep_fit(docs, none).count() == 6 and keep_fit(docs, none).columns == docs.columns
    odd = spark.createDataFrame([(0, None, 1), (1, 1, None), (2, 1, 0), (2, 1, 0), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert keep_fit(docs, odd).count() == 6
    assert keep_fit(docs.where("false"), none).count() == 0


def test_rates_by_hand(spark):
    """Rates, posteriors and decisions from each document's evidence, by the formulas in plain Python."""
    docs, labels = corpus(spark, 400, 3)
    docs = docs.selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, if(doc_id % 2 = 0, 'en', 'de')) AS lang", "source", "n_chars")
    made, name = classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = made.select("doc_id", "source", "lang", f"{name}.*").collect()
    p = {r.doc_id: 1 - (1 - 1 / (1 + math.exp(-r.low))) * (1 - 1 / (1 + math.exp(-r.toxic))) for r in rows}
    group = lambda key: {k: [p[r.doc_id] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = group(lambda r: r.source), group(lambda r: (r.source, r.lang))
    n, mean = len(rows), sum(p.values()) / len(rows)
    squares = sum(sum(v) ** 2 / len(v) for v in hosts.values())
    between = max((squares - n * mean * mean - (len(hosts) - 1) * mean * (1 - mean)) / max(n - sum(len(v) ** 2 for v in hosts.values()) / n, 1.0), 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6)
    host_rate = {k: (sum(v) + strength * mean) / (len(v) + strength) for k, v in hosts.items()}
    path_rate = {k: (sum(v) + strength * host_rate[k[0]]) / (len(v) + strength) for k, v in paths.items()}
    odds = lambda x: math.log(x / (1 - x))
    for r in rows:
        rate = path_rate[r.source, r.lang]
        own = max(-30.0, min(30.0, math.log(p[r.doc_id] / max(1 - p[r.doc_id], 1e-13))))
        want = own + 0.5 * max(-4.0, min(4.0, odds(min(max(rate, 1e-4), 1 - 1e-4)) - odds(mean)))
        assert abs(r.host_rate - host_rate[r.source]) < 1e-9 and abs(r.path_rate - rate) < 1e-9
        assert abs(r.log_odds - want) < 1e-6 and r.rejected == (r.log_odds > 0)


def test_contradicting_labels(spark):
    """The worse label counts, in whatever order they come."""
    docs, labels = corpus(spark, 300, 4)
    twice = labels + [(i, 1, 0) for i, _, _ in labels]
    one, two = (sorted(keep_fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).select("doc_id").collect()) for x in (labels, twice[::-1]))
    assert one == two and len(one) < 300


def test_terms_by_hand(spark):
    """The chosen terms are those that stand out most by plain counting."""
    docs, labels = corpus(spark, 300, 5)
    low, toxic = train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most_terms=20)
    bad = {i for i, _, t in labels if t}
    has = {}
    for r in docs.collect():
        words = Words(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]), ALNUM)
        for term in document_terms(words)[1].tolist():
            has.setdefault(term, set()).add(r.doc_id)

    def z(rows):
        a, b = len(rows & bad), len(rows - bad)
        parts = [a + 0.5, len(bad) - a + 0.5, b + 0.5, 300 - len(bad) - b + 0.5]
        return abs(math.log(parts[0] / parts[1]) - math.log(parts[2] / parts[3])) / math.sqrt(sum(1 / x for x in parts))

    ranked = sorted((-round(z(rows), 9), term) for term, rows in has.items() if len(rows) >= 5 and z(rows) > 3)[:20]
    assert sorted(toxic.terms.tolist()) == sorted(t for _, t in ranked) and len(low.terms) <= 20
