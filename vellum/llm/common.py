"""What the operators share: sessions, tables, Arrow maps, cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one Arrow batch; sessions that set it themselves keep their value.
BATCH_BYTES = "8388608"


def _ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context, so that they can import it on any cluster."""
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="vellum-"), "vellum.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(path)
    context._vellum_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package, and bounds Arrow batches by bytes as well as by rows, so that a batch of long texts stays small."""
    _ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all runs on one machine, as in tests."""
    at, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if at is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"vellum-{uuid.uuid4().hex}"))
    return (at or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and goes on from there: lost executors lose nothing, and a plan runs once."""
    path = f"{checkpoint_dir(df.sparkSession)}/vellum-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, what) -> tuple[DataFrame, int]:
    """cut, and how many rows meet ``what``, counted while they are written."""
    seen = Observation()
    made = cut(df.observe(seen, F.count_if(what).alias("n")))
    return made, seen.get["n"]


#: Numbers of one coarse group of running_starts.
COARSE = 1024


def running_starts(sums: DataFrame, by: list[str], number: str, value: str, out: str) -> DataFrame:
    """sums with the sum of ``value`` over the smaller numbers of its ``by``: a whole number from 0, one row for each (by, number).

    In two levels, within groups of COARSE numbers and over these groups, so that no
    task orders more than a thousandth of what one key has.
    """
    coarse, before = free_name(sums, "coarse"), Window.unboundedPreceding
    dealt = sums.withColumn(coarse, F.floor(F.col(number) / COARSE).cast("long"))
    over = Window.partitionBy(*by, F.lit(0)).orderBy(coarse).rowsBetween(before, -1)
    totals = dealt.groupBy(*by, coarse).agg(F.sum(value).alias("_total")).withColumn("_upto", F.coalesce(F.sum("_total").over(over), F.lit(0)))
    totals = totals.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, coarse)], "_upto")
    within = Window.partitionBy(*by, coarse).orderBy(number).rowsBetween(before, -1)
    dealt = dealt.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, coarse)]
    joined = dealt.join(totals, same).withColumn(out, (F.col(out) + F.col("_upto")).cast("long"))
    return joined.select(*sums.columns, out)


def looked_up(rows: DataFrame, keys: list[str], by: list[str], known: DataFrame, values: list[str]) -> DataFrame:
    """rows with the ``values`` that known has for their ``keys``, null where it has none.  known: one row for each key; no key is null.

    Rows fall into buckets by a hash of ``by``, which should tell rows of one key apart.
    A bucket asks for each of its keys once, and the answer goes back to the bucket: a
    key that very many rows have costs as many requests as there are buckets.
    """
    bucket, n = free_name(rows, "bucket"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*by), F.lit(n)))
    answers = dealt.select(bucket, *keys).distinct().join(known.select(*keys, *values), keys)
    return dealt.join(answers, [bucket, *keys], "left").select(*rows.columns, *values)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
