"""op8: documents in shards."""

from pyspark.sql import functions as F

from ..common import table, text_of
from ..sharding import external_shuffle

NAME = "op8_external_shuffle"
SQL = None


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed, shard, slot = external_shuffle(docs)
    text = text_of(placed)
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
