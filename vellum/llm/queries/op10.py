"""op10: license labels of documents."""

from pyspark.sql import functions as F

from ..common import table
from ..licenses import scan_licenses

NAME = "op10_license_scan"


def query(spark, sf_dir):
    found, name = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = F.col(name)
    places = F.transform(c["phrases"], lambda x: x["first"])
    base = F.transform(c["phrases"], lambda x: x["label"])
    own = F.transform(F.filter(c["spans"], lambda x: x["stands"]), lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform(c["spans"], lambda x: x["covered"])), F.lit(0.0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


SQL = None
