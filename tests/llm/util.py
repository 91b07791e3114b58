import re

import pyarrow  # noqa: F401

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, NONSPACE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def alnum(text):
    return ALNUM.findall((text or "").translate(ASCII_LOWER))


def words(text):
    return NONSPACE.findall((text or "").translate(ASCII_LOWER))


def documents(spark, texts, first=0):
    """A documents table of texts, or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i + first, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, ("en", "de", None)[(i or 0) % 3], ("a", "b", "c", None)[(i or 0) % 4], len(t or "")) for i, t in rows], DOCS)


def save(spark, folder, **tables):
    """Tables as a scale-factor folder."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
