"""op2: token counts of documents under the byte-level vocabulary."""

from pyspark.sql import functions as F

from ..common import table, text_of
from ..tokens import with_token_counts

NAME = "op2_token_counts"
LIMIT = 512
SQL = None


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted, name = with_token_counts(docs, vocabulary())
    tokens = F.col(name)
    return counted.select("doc_id", F.octet_length(text_of(counted)).cast("long").alias("n_bytes"), tokens.alias("n_tokens"), (tokens > LIMIT).alias("over_limit"))
