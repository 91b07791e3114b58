"""op5: the mix of documents."""

from pyspark.sql import functions as F

from ..common import table
from ..mixing import mix

NAME = "op5_mix_sources"
SQL = None


def query(spark, sf_dir):
    made = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).taken()
    return made.select("doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", "taken")
