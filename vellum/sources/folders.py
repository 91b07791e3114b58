"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each context: functions that run there import it."""
    context = spark.sparkContext
    if not getattr(context, "_vellum_layout_shipped", False):
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="vellum-"), "vellum_layout.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, str(file.relative_to(root.parent)))
        context.addPyFile(path)
        context._vellum_layout_shipped = True
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder's path: in the one that spark.checkpoint.dir names, or the machine's own where all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "vellum-scratch")
    return f"{at.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a new folder: worked out once, and kept where a lost executor takes nothing with it."""
    ship(df.sparkSession)
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
