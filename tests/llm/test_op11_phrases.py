import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from tests.llm.util import ASCII_LOWER, documents, save
from vellum.llm.common import looked_up
from vellum.llm.phrases import best, collocations, distinct_pieces, independent, phrase_counts, scored
from vellum.llm.queries import op11


def brute(rows, most=3, least=10, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    held = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    made = []
    for (lang, *words), a in held.items():
        n = len(words)
        if any(100 * b >= share * a for g, b in held.items() if g[0] == lang and len(g) > n + 1 and any(list(g[1 + i : 1 + i + n]) == words for i in range(len(g) - n))):
            continue
        cuts = [(int(Fraction(1_000_000 * a * a, f[(lang, *words[:k])] * f[(lang, *words[k:])])), k) for k in range(1, n)]
        score, k = min(cuts)
        made.append((lang, " ".join(words), a, f[(lang, *words[:k])], f[(lang, *words[k:])], total[lang], score))
    made.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    out = []
    for lang, phrase, *rest in made:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase, *rest))
    return out


def texts(seed, n=300):
    rng = random.Random(seed)
    unit = ["New York", "of the", "a a a", "é ß漢 x", "to\tbe or not", "one", "In  the end", "q\x0bq", "w! w", "z\rz"]
    out = [rng.choice([". ", ", ", " ", "  ", "\n"]).join(rng.choice(unit) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return out + [None, "", " \t ", "...", "same piece again, same piece again."] + ["same piece again"] * 30 + ["long " * 4000 + "tail"]


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_query(spark, tmp_path):
    """The query, its SQL and the brute-force version on hard texts."""
    docs = documents(spark, texts(1))
    folder = save(spark, tmp_path, documents=docs)
    got = op11.query(spark, folder)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    want = sorted(brute([(r.lang, r.text) for r in docs.collect()]))
    assert rows(got) == want and {w[0] for w in want} == {"en", "de", "und"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.sql(op11.SQL).fetchall()) == want


def test_longer_phrases(spark):
    """Four words, other limits, few rows a language."""
    docs = documents(spark, texts(2, 120))
    given = [(r.lang, r.text) for r in docs.collect()]
    for most, least, share, top in ((4, 3, 70, 5), (2, 4, 50, 2000), (3, 1, 101, 40)):
        assert rows(collocations(docs, most=most, least=least, share=share, top=top)) == sorted(brute(given, most, least, share, top))


def test_large_counts(spark):
    """Products of three counts pass 64 bits; floors and the choice of the cut stay exact."""
    a, l1, r1, l2, r2 = 3_000_000_000_001, 9_000_000_000_007, 4_000_000_000_009, 3_000_000_000_001, 12_000_000_000_029
    counts = spark.createDataFrame([("en", "x y z", 3, a), ("en", "x", 1, l1), ("en", "y z", 2, r1), ("en", "x y", 2, l2), ("en", "z", 1, r2), ("en", "y", 1, 10**15)], "lang string, gram string, words int, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in scored(counts).collect()}
    assert got["x y z"] == min(((a, left, r, 1_000_000 * a * a // (left * r)) for left, r in ((l1, r1), (l2, r2))), key=lambda x: x[3])
    assert got["x y"] == (l2, l1, 10**15, 1_000_000 * l2 * l2 // (l1 * 10**15))


def test_pieces_once(spark):
    """Copies are one piece with a multiplicity, and count as often as they come."""
    docs = documents(spark, ["One  two,\tone two. three"] * 60 + ["one two"])
    pieces = distinct_pieces(docs.withColumn("lang", F.lit("en")), "lang", "text")
    assert sorted(map(tuple, pieces.collect())) == [("en", "one two", 121), ("en", "three", 60)]
    assert {(r.gram, r.f) for r in phrase_counts(pieces, 2, 61).collect()} == {("one", 121), ("two", 121), ("one two", 121)}


def test_lookups(spark):
    """Every row gets what its key has, and a key that all rows have is asked for once by a bucket."""
    asked = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    known = spark.createDataFrame([("hot", 1), ("3", 2)], "key string, value int")
    got = looked_up(asked, ["key"], ["row"], known, ["value"])
    assert {(r.key, r.value) for r in got.where("key in ('hot', '3', '6')").collect()} == {("hot", 1), ("3", 2), ("6", None)} and got.count() == 5000


def test_ties_names_and_empty(spark):
    tied = spark.createDataFrame([("en", p, 2, 5, 5, 5, 10) for p in ("b a", "a é", "a z", "a a")], "lang string, phrase string, words int, a long, l long, r long, score long")
    assert [r.phrase for r in best(tied, 3).orderBy("rank").collect()] == ["a a", "a z", "a é"]
    assert independent(tied).count() == 4
    docs = documents(spark, ["x y"] * 10).withColumnsRenamed({"doc_id": "piece", "source": "LANG_", "n_chars": "gram"})
    assert [(r.lang, r.phrase, r.a) for r in collocations(docs, least=2).orderBy("lang").collect()] == [("de", "x y", 3), ("en", "x y", 4), ("und", "x y", 3)]
    assert collocations(docs.where("false")).count() == 0
