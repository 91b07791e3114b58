import corpus_pipeline
from vellum.llm.common import cut
from vellum.llm.classify import classify
from tests.llm.test_op1_decontaminate import brute as contaminated
from tests.llm.test_op4_near_dups import brute as groups
from tests.llm.test_op9_classify import corpus as labelled
from tests.llm.util import save

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(SF + "/documents.parquet")
    columns = docs.columns
    before = [tuple(r) for r in docs.collect()]
    made, name = classify(docs, spark.read.parquet(SF + "/labels.parquet"))
    rejected = {r[0] for r in made.where(f"{name}.rejected").select("doc_id").collect()}
    items = [tuple(r) for r in spark.read.parquet(SF + "/benchmark.parquet").select("item_id", "text").collect()]
    for k, (title, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SF))
        after = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == columns, title
        if k == 0:
            want = [r for r in before if r[0] not in rejected]
        elif k == 1:
            kept = groups([r[:2] for r in before], 5)
            want = [r for r in before if kept[r[0]][2]]
        elif k == 2:
            want = [r for r in before if not contaminated(r[1], items)[-1]]
        elif k == 3:
            assert set(after) <= set(before) and max(after.count(r) for r in after) <= 3
            want = after
        else:
            assert docs.columns[:5] == columns and sorted(r[:5] for r in after) == sorted(before)
            n = len(after)
            assert sorted((r[5], r[6]) for r in after) == sorted((i % 8, i // 8) for i in range(n))
            want = after
        assert sorted(after) == sorted(want), title
        assert after, title
        before = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(before)


def test_quality_by_labels(spark, tmp_path):
    """The quality stage against labels that the classifier hasn't seen; kept rows come unchanged, and once."""
    docs, labels = labelled(spark)
    d = save(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in corpus_pipeline.quality(spark, docs, d).collect()]
    kept = {r[0] for r in got}
    assert len(got) == len(kept) and all(rows[r[0]] == r for r in got)
    wrong = [i for i, q, t in labels[1000:] if (i in kept) != (q == 1 and t == 0)]
    assert len(wrong) <= 15, len(wrong)
