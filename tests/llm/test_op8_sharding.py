import random
import zlib

import numpy as np

from tests.llm.util import documents, save
from vellum.llm import sharding
from vellum.llm.queries import op8


def rows_of(n=300):
    rng = random.Random(9)
    return [(i, rng.choice([None, "", "same text", "é" * rng.randint(0, 500)])) for i in range(n)]


def test_query(spark, tmp_path, monkeypatch):
    rows = rows_of()
    d = save(spark, tmp_path, documents=documents(spark, rows))
    for size in (16 << 20, 20_000, 1000):  # one bucket, one to a partition, several to one
        monkeypatch.setitem(sharding.external_shuffle.__kwdefaults__, "bucket_bytes", size)
        got = op8.query(spark, d).collect()
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        slots = {k: sorted(r.slot for r in got if r.shard == k) for k in range(8)}
        assert all(v == list(range(len(v))) for v in slots.values()) and np.ptp([len(v) for v in slots.values()]) <= 1
        assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, op8.query(spark, d).collect()), key=repr)  # reruns agree
        order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
        assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def test_equal_records_and_long_texts(spark):
    """Copies of one record are dealt over buckets, and a text larger than a bucket is one record of its bucket."""
    docs = documents(spark, [(1, "copy " * 20)] * 3000 + [(2, "long " * 40_000)])
    placed, shard, slot = sharding.external_shuffle(docs, shards=4, bucket_bytes=20_000)
    rows = placed.collect()
    assert sorted((r[shard], r[slot]) for r in rows) == sorted((i % 4, i // 4) for i in range(3001))
    assert [len(r.text) for r in rows if r.doc_id == 2] == [200_000]
    plan = placed._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" in plan


def test_fisher_yates():
    counts = np.zeros((4, 4), int)
    for seed in range(4000):
        p = sharding.fisher_yates(4, np.random.default_rng(seed))
        assert sorted(p) == [0, 1, 2, 3]
        counts[np.arange(4), p] += 1
    assert np.abs(counts / 4000 - 0.25).max() < 0.03
    assert sharding.fisher_yates(0, np.random.default_rng(1)).tolist() == [] and sharding.fisher_yates(1, np.random.default_rng(1)).tolist() == [0]


def test_clashes_repeats_empty(spark, tmp_path):
    docs = documents(spark, [(1, "a")] * 5 + [(None, None)] * 3).withColumnsRenamed({"lang": "shard", "source": "slot", "n_chars": "bucket"})
    placed, shard, slot = sharding.external_shuffle(docs, shards=3)
    assert placed.columns == [*docs.columns, "_shard", "_slot"]
    assert sorted((r[shard], r[slot]) for r in placed.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert sharding.external_shuffle(docs.where("false"))[0].count() == 0
    sharding.write_shards(documents(spark, rows_of(40)), str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect()[0]["count"] == 10
