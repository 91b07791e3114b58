import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import common


def test_running_starts(spark, monkeypatch):
    """Sums over smaller numbers, in one group of numbers or many; null keys are a key of their own."""
    rng = random.Random(1)
    rows = [(k, n, rng.randint(0, 9)) for k in ("a", "b", None) for n in rng.sample(range(60), 40)]
    frame = spark.createDataFrame(rows, "k string, n long, v long")
    for size in (1024, 7, 1):
        monkeypatch.setattr(common, "COARSE", size)
        got = {(r.k, r.n): r.s for r in common.running_starts(frame, ["k"], "n", "v", "s").collect()}
        assert got == {(k, n): sum(v for x, m, v in rows if x == k and m < n) for k, n, _ in rows}
    whole = {r.n: r.s for r in common.running_starts(frame.where("k = 'a'").drop("k"), [], "n", "v", "s").collect()}
    assert whole == {n: sum(v for x, m, v in rows if x == "a" and m < n) for k, n, _ in rows if k == "a"}
    assert common.running_starts(frame.where("false"), ["k"], "n", "v", "s").count() == 0


def test_cut_counting(spark):
    made, n = common.cut_counting(spark.range(100), F.col("id") % 3 == 0)
    assert n == 34 and made.count() == 100
    assert common.cut_counting(spark.range(0), F.lit(True))[1] == 0


def test_no_shared_folder():
    """A cluster that names no folder is told so; nothing goes to one machine's own."""

    class Session:
        conf = type("", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        common.checkpoint_dir(Session)
