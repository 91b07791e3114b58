from vellum.operators.rope import replayed_text
from vellum.streaming import replay

SCHEMA = "doc_id long, seq long, op string, start long, end long, piece string"


def test_replay(spark, tmp_path):
    rows = [(d, s, ("insert", "replace", "delete")[s % 3], s % 4, s % 4 + s % 3, f"w{s}") for d in (1, 2) for s in range(20)]
    source, seen = str(tmp_path / "in"), {}
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = replay.texts(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda f, _: seen.update({r.doc_id: r.text for r in f.collect()})).start()
    query.processAllAvailable()
    query.stop()
    want = {r.doc_id: r.text for r in replayed_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert seen == want
