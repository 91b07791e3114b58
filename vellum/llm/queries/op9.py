"""op9: quality classes of documents."""

from pyspark.sql import functions as F

from ..classify import classify
from ..common import table

NAME = "op9_quality"
SQL = None


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    made, name = classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    c = F.col(name)
    return made.select("doc_id", c["low"].alias("low_log_odds"), c["toxic"].alias("toxic_log_odds"), c["host_rate"].alias("host_rate"), c["path_rate"].alias("path_rate"), c["log_odds"].alias("log_odds"), (~c["rejected"]).alias("kept"))
