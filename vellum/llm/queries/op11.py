"""op11: phrases of two and three words that belong together, by language."""

from ..common import table
from ..phrases import collocations

NAME = "op11_phrases"


def query(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) AS q),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(m)) AS q GROUP BY ALL),
cand AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.m, c.g, a, k, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) AS c
  JOIN f AS l ON l.lang = c.lang AND l.g = array_to_string(w[1:k], ' ') JOIN f AS r ON r.lang = c.lang AND r.g = array_to_string(w[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
within AS (
  SELECT lang, g, max(a) AS b FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM cand WHERE m = 3) AS q GROUP BY 1, 2),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank
  FROM scored AS s LEFT JOIN within AS i ON i.lang = s.lang AND i.g = s.g WHERE b IS NULL OR 100 * b < 50 * a)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
