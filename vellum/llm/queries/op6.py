"""op6: fingerprints of documents and of their edited texts."""

from ..common import table
from ..fingerprints import with_edits

NAME = "op6_fingerprints"
SQL = None


def query(spark, sf_dir):
    return with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
