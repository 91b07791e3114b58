"""The corpus pipeline: documents through quality, near-duplicates, contamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns documents; all but the last
return the columns of documents.  ``run`` writes each stage's result as Parquet in
the folder that spark.checkpoint.dir names and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.classify import keep_fit
from vellum.llm.common import cut, table
from vellum.llm.decontaminate import drop_contaminated
from vellum.llm.mixing import mixed_documents
from vellum.llm.near_dups import keep_one_of_each
from vellum.llm.sharding import external_shuffle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_fit(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id.

    Five-word shingles and a similarity of 0.8, as for all near-duplicate stages; the
    four words of query op4 are that query's own contract.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words, or more, in benchmark windows go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of their source takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shuffled shards: their columns, shard and slot."""
    placed, shard, slot = external_shuffle(docs)
    return placed.withColumnsRenamed({shard: "shard", slot: "slot"})


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]
#: SQL can't express the classifier's fit; tests hold the quality stage against labels that it hasn't seen, each other stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
