"""op13: periodic runs of words in documents, a tenth of which are made periodic first."""

from pyspark.sql import functions as F

from ..common import table, text_of
from ..runs import with_runs

NAME = "op13_periodic_runs"
SQL = None


def made_periodic(docs):
    """docs whose h % 10 = 0, h the checksum of the id: from word a on, the p words from a on come again and again."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    chosen = docs.withColumn("_g", F.when(h % 10 == 0, g)).withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("_w").cast("long")
    sized = chosen.withColumn("_n", F.when(n > 0, n)).withColumn("_a", F.pmod("_g", "_n").cast("int"))
    rest = F.col("_n") - F.col("_a")
    sized = sized.withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    words = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), rest.cast("int")))
    return sized.select("doc_id", F.when(F.col("_n").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made, name = with_runs(made_periodic(docs.select("doc_id", text_of(docs).alias("text"))))
    runs = F.col(name)["runs"]
    more = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    listed = F.transform(runs, lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n")))
    best = made.select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.aggregate(runs, F.get(runs, F.lit(0)), more).alias("b"), F.array_join(listed, "").alias("l"), F.col(name)["collapsed"].alias("c"))
    return best.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("b.length * 1000 div b.period").alias("exponent_milli"), F.sha2("l", 256).alias("runs_sha256"), F.sha2("c", 256).alias("collapsed_sha256"),
    )
