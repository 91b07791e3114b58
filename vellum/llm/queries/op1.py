"""op1: benchmark decontamination of documents against benchmark."""

from pyspark.sql import functions as F

from ..common import table
from ..decontaminate import find_contamination, hit_count, is_contaminated

NAME = "op1_decontaminate"


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, hits = find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.col(hits)["items"]
    return marked.select(
        "doc_id",
        F.col(hits)["n_words"].alias("n_words"),
        hit_count(hits).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(hits).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 13) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM il, unnest(range(1, len(w) - n + 2)) AS u(p)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, l.n, p, array_to_string(w[p:p + l.n - 1], ' ') AS g FROM dw, lens l, unnest(range(1, len(w) - l.n + 2)) AS u(p)),
hit AS (SELECT dg.doc_id, dg.p, dg.n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hit) h, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) h GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
