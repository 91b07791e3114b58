"""What documents unfold to stays where it is."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from vellum.operators import bins, rope
from vellum.sources import views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """Joins as for large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["spatial_map", "document_text", "line_reconstruct", "selections_overlap", "selection_overlap", "word_viewports"])
def test_words_are_not_shuffled(shuffled, name):
    plan = queries()[name](shuffled, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    # documents while they are whole, and the lists of anchors
    assert dealt and all("REPARTITION_BY_COL" in line or "hashpartitioning(_key" in line for line in dealt), dealt


def test_overlaps_of_few_and_many(shuffled, monkeypatch):
    draw = random.Random(3)
    left = shuffled.createDataFrame([(draw.randint(0, 4), i, a := draw.randint(0, 90), a + draw.randint(-1, 9)) for i in range(300)], "k long, l long, a long, b long")
    right = shuffled.createDataFrame([(k, i, c := draw.randint(0, 90), c + draw.randint(-1, 30)) for i, k in enumerate([0] * 9 + [1, 2, 2, 7])], "k long, r long, c long, d long")
    axes = [bins.Axis(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 16)]
    want = sorted(map(tuple, bins.overlap_join(left, right, ["k"], axes).collect()))
    assert want
    for few in (1, 32):
        monkeypatch.setattr(bins, "FEW", few)
        assert sorted(map(tuple, bins.overlap_join(left, right, ["k"], axes, together=True).collect())) == want


def test_large_tables_go_to_more_tasks(spark, monkeypatch):
    docs = views.table(spark, SMALL, "documents")
    monkeypatch.setattr(views, "DEALT", 4096)
    assert views.dealt(docs).rdd.getNumPartitions() == -(-views._size(docs) // 4096) > 8


def test_edits_are_taken_in_slices(monkeypatch):
    sizes = [3, 0, 50, 1, 1, 1, 60, 0, 0, 2]
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(range(sum(sizes))))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), lists], names=["at", "need"])
    monkeypatch.setattr(rope, "AT_ONCE", 16)
    cut = list(rope._slices([batch, batch.slice(0, 0)], 1))
    assert len(cut) == 3 and pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert all(len(b.column(1).flatten()) <= 60 + 16 for b in cut)
