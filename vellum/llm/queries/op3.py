"""op3: secret spans of documents."""

from pyspark.sql import functions as F

from ..common import table
from ..secrets import BASE, find_secrets, listed

NAME = "op3_secret_spans"


def query(spark, sf_dir):
    found, name = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(F.col(name), lambda x: x["kind"] == kind)).cast("long")
    base = listed(name, lambda x: x["rank"] < len(BASE))
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(name).alias("spans")
    )


def _spans(kind: str, rank: int, pattern: str, least: int, group: int) -> str:
    """SQL for one rule's spans: gaps and matches in order give the positions."""
    part = f"regexp_extract_all(t, r.p, {group})"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, e FROM (
    SELECT doc_id, unnest(m) AS m1, unnest(g) AS g1, unnest(range(1, len(m) + 1)) AS i, gaps, m,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, s + length(m1) AS e
    FROM (SELECT doc_id, regexp_extract_all(t, r.p) AS m, {part} AS g, string_split_regex(t, r.p) AS gaps FROM d, (SELECT '{pattern}' AS p) r)) q
  WHERE length(g1) >= {least}"""


_LETTERS = {"password": "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "passwd": "[Pp][Aa][Ss][Ss][Ww][Dd]", "secret": "[Ss][Ee][Cc][Rr][Ee][Tt]", "token": "[Tt][Oo][Kk][Ee][Nn]", "api_?key": "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"}
_QUOTE = "[\"'']?"
_SQL_RULES = (
    ("assign", "(" + "|".join(_LETTERS.values()) + ")" + _QUOTE + " *[:=] *" + _QUOTE + "([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]{24,}", 24, 0),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
    ("url_password", r"[a-z][a-z0-9+.-]{0,19}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", 1, 0),
)
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ("
    + " UNION ALL ".join(_spans(k, i, p, least, g) for i, (k, p, least, g) in enumerate(_SQL_RULES))
    + """),
a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
)
