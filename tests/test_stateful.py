"""Edit streams that arrive out of order, twice and late, and documents that fall idle."""

import datetime as dt

import pytest

from vellum.streaming import stateful

SCHEMA = "doc_id long, seq long, at timestamp, op string, start long, end long, piece string"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stateful.with_state_store(spark)
    yield
    spark.conf.set(key, before)


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def run(spark, tmp_path, batches, idle_minutes):
    """The texts that each batch brings, in order."""
    source, seen = str(tmp_path / "in"), []
    for i, rows in enumerate(batches):
        made = [(d, s, at(m), "insert", p, 0, t) for d, s, m, p, t in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.replayed(spark.readStream.schema(SCHEMA).parquet(source), "10 minutes", idle_minutes * 60_000)
        query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda f, _: seen.extend((r.doc_id, r.seq, r.text) for r in f.collect())).start()
        query.awaitTermination()
    return seen


def test_order_copies_late_and_idle(spark, tmp_path, store):
    batches = [
        [(1, 2, 2, 1, "b"), (1, 1, 1, 0, "a"), (1, 1, 1, 0, "a"), (2, 1, 1, 0, "x")],
        [(1, 4, 4, 3, "d"), (1, 3, 3, 2, "c"), (1, 2, 2, 1, "b")],  # out of order over batches, and a copy
        [(9, 1, 40, 0, "clock")],  # the watermark passes minute 30
        [(1, 5, 5, 0, "late"), (2, 2, 35, 1, "y"), (9, 2, 60, 0, "clock")],
        [(9, 3, 500, 0, "clock")],  # all others fall idle
        [(2, 9, 505, 0, "new"), (9, 4, 900, 0, "clock")],
        [(9, 5, 901, 0, "clock")],
    ]
    seen = run(spark, tmp_path, batches, 120)
    of = lambda d: [(s, t) for k, s, t in seen if k == d]
    assert of(1)[-1] == (4, "abcd") and all("late" not in t for _, t in of(1))
    assert of(2) == [(1, "x"), (2, "xy"), (9, "new")]
