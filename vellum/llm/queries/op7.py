"""op7: personal data in documents."""

from pyspark.sql import functions as F

from ..common import table
from ..privacy import KINDS, find_private

NAME = "op7_personal_data"


def _matches(rank: int, kind: str, pattern: str, good: str) -> str:
    """SQL for one kind's spans: gaps and matches in order give the positions; ``good`` tests a match v with its digits g."""
    return f"""
  SELECT rn, {rank} AS rank, '{kind}' AS kind, v, s, s + length(v) AS e FROM (
    SELECT rn, v, regexp_replace(v, '[^0-9]', '', 'g') AS g,
      list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS s
    FROM (SELECT rn, m, gaps, unnest(m) AS v, unnest(range(len(m))) AS i FROM (SELECT rn, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS gaps FROM d) AS q1) AS q2) AS q3
  WHERE {good}"""


_LUHN = "list_sum(list_transform(range(length(g)), lambda i: CAST(g[length(g) - i] AS INTEGER) * (1 + i % 2) - CASE WHEN CAST(g[length(g) - i] AS INTEGER) * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents), spans AS ("
    + " UNION ALL ".join(
        _matches(i, *x)
        for i, x in enumerate(
            (
                ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
                ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0"),
                ("card", "[0-9]([ -]?[0-9])+", f"length(g) BETWEEN 16 AND 19 AND {_LUHN}"),
                ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(g) BETWEEN 8 AND 15"),
            )
        )
    )
    + f"""),
lowered AS (SELECT rn, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM d),
pieces AS (SELECT rn, unnest(range(len(w))) AS i, unnest(w) AS word, unnest(gaps[1:len(w)]) AS gap FROM (SELECT rn, regexp_extract_all(t, '{_WORD}') AS w, string_split_regex(t, '{_WORD}') AS gaps FROM lowered) AS q),
words AS (SELECT rn, i, word, e - length(word) AS s, e FROM (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY rn ORDER BY i) AS e FROM pieces) AS q),
good AS (SELECT * FROM words AS w WHERE length(word) >= 4 AND NOT regexp_matches(word, '[0-9]') AND NOT EXISTS (SELECT 1 FROM spans AS p WHERE p.rn = w.rn AND w.e > p.s AND w.s < p.e)),
around AS (SELECT p.rn, kind || v AS entity, p.s AS ps, p.e AS pe, count(*) FILTER (w.e <= p.s) AS before, count(*) FILTER (w.s < p.e) AS after FROM spans AS p JOIN words AS w ON w.rn = p.rn GROUP BY ALL),
near AS (SELECT DISTINCT a.rn, entity, word, g.s, g.e FROM around AS a JOIN good AS g ON g.rn = a.rn AND (g.i BETWEEN before - 8 AND before - 1 OR g.i BETWEEN after AND after + 7)),
pairs AS (SELECT entity, word, count(DISTINCT near.rn) AS n_both, count(DISTINCT t) AS texts FROM near JOIN d USING (rn) GROUP BY 1, 2 HAVING count(DISTINCT t) >= 3),
terms AS (SELECT word, count(DISTINCT rn) AS n FROM words WHERE word IN (SELECT word FROM pairs) GROUP BY 1),
entities AS (SELECT entity, count(DISTINCT rn) AS n_entity FROM near GROUP BY 1),
told AS (SELECT p.entity, p.word FROM pairs AS p JOIN terms USING (word) JOIN entities USING (entity), (SELECT count(*) AS rows FROM d) AS r
  WHERE n_entity < rows AND log2(n_both * CAST(rows AS DOUBLE) / (n_entity * n)) / -log2(n_entity / CAST(rows AS DOUBLE)) >= 8e-1),
marks AS (SELECT DISTINCT near.rn, s, e FROM near JOIN told USING (entity, word)),
base AS (SELECT rn, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS listed FROM spans GROUP BY 1),
marked AS (SELECT rn, string_agg('term:' || s || ':' || e, ',' ORDER BY s, e) AS listed FROM marks GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
  sha256(coalesce(base.listed, '')) AS base_sha256, concat_ws(',', base.listed, marked.listed) AS spans
FROM d LEFT JOIN base USING (rn) LEFT JOIN marked USING (rn)"""
)


def query(spark, sf_dir):
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    listed = lambda column, kind=None: F.transform(column, lambda x: F.concat_ws(":", x["kind"] if kind is None else F.lit(kind), x["start"], x["end"]))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(listed("spans"), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(listed("spans"), listed("terms", "term")), ",").alias("spans"),
    )
