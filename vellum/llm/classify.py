"""Quality classifier with hierarchical empirical Bayes.

Evidence of one document: log-odds that it is unfit (of low quality or toxic),
from two logistic models over words, word beginnings and the text's shape.  They
are fitted on a bounded sample of labelled rows: MOST_LABELLED rows, those with
the smallest seeded hash of their id; a smaller table is used whole.  A model has
MOST_TERMS terms at most, a parameter of the fit: those whose log-odds between the
classes stand out most.  Their counts meet on the executors; the driver sees the
chosen terms and, of each labelled row, which of them it has.

Hosts and paths: all documents' unfit probabilities are summed by host (source)
and path (host and language).  A Beta prior is fitted to the hosts' rates by
moments, and shrinks each host's rate toward the global one by its strength over
the host's count; paths shrink toward their host in the same way.  A document's
posterior log-odds are its own evidence plus its path's log-odds over the global
ones, as far as the path's share of the evidence is trusted (SITE_WEIGHT).

Texts are read into evidence once; that is written with what is carried along, and
sums and posteriors read it.  Sums of a host meet after partial aggregation, and the rates, a row for each path,
join back on the path and a salt, so a host with a third of all rows is spread.

Defined cases: a null text is empty and scores by its shape alone; null hosts and
languages are a host and a language of their own; repeated rows each get their own
score; labels without a document or with nulls are left out, and of labels that
contradict each other the worse counts (low quality, toxic); with no labels of
one of the kinds nothing is rejected for that reason; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, prepare, text_of
from .kernels import ALNUM, NONSPACE, U64, Words, slices

MOST_LABELLED = 6000
MOST_TERMS = 300
PREFIXES = (4, 5, 6)
SITE_WEIGHT, SALTS = 0.5, 16
# counts of capital letters, symbols and line feeds, 21 bits each, in one number
_LETTER_KINDS = np.array([(65 <= b <= 90) + ((chr(b) in "!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~") << 21) + ((b == 10) << 42) for b in range(256)], np.int64)


def _terms(words: Words) -> list[np.ndarray]:
    """32-bit hashes of words and of their beginnings, 0 where there is none; each list one for each word."""
    return [(h >> U64(32)).astype(np.uint32) for h in (words.hashes(), *words.prefix_hashes(PREFIXES))]


def document_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs of a slice, each once."""
    row, terms = words.row_of_word(), _terms(words)
    rows, terms = np.concatenate([row] * len(terms)), np.concatenate(terms)
    rows, terms = rows[terms != 0], terms[terms != 0]
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[new], terms[new]


SHAPE = 10


def shape(body: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """(rows, SHAPE): the text's form."""
    n = np.maximum(np.diff(offsets), 1)
    fields = [_LETTER_KINDS] if len(body) < 1 << 21 else [_LETTER_KINDS >> s & 1 for s in (0, 21, 42)]
    sums = [np.concatenate([[0], np.cumsum(t[body])]) for t in fields]
    kinds = [t[offsets[1:]] - t[offsets[:-1]] for t in sums]
    upper, symbol, line = ((kinds[0] >> s & (1 << 21) - 1) / n for s in (0, 21, 42)) if len(kinds) == 1 else (k / n for k in kinds)
    plain = Words(body, offsets, NONSPACE)
    hashes, row = plain.hashes(), plain.row_of_word()
    counts = np.maximum(plain.counts, 1)
    distinct = np.zeros(len(n))
    again = np.zeros(len(n))
    if len(hashes):
        keys = np.sort(row.astype(U64) << U64(40) | hashes >> U64(24))  # row, then 40 bits of the word
        new = np.append(True, keys[1:] != keys[:-1])
        distinct = np.bincount((keys[new] >> U64(40)).astype(np.int64), minlength=len(n)) / counts
        same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
        again = np.bincount(row[1:][same], minlength=len(n)) / counts
    length = np.log1p(plain.counts)
    out = np.stack([upper, upper > 0.2, symbol, symbol > 0.08, 10 * line, distinct, distinct * length, again, again > 0.2, length], axis=1).astype(np.float64)
    out[:, 9] /= 10
    out[:, 6] /= 10
    return out


class Model:
    """A logistic model over chosen terms and the shape."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = terms, weights, bias  # terms sorted; weights: terms, then shape


class Scorer:
    """Both models over the terms of either."""

    def __init__(self, models: tuple[Model, ...]):
        self.terms = np.unique(np.concatenate([m.terms for m in models]))
        self.weights = np.zeros((len(models), len(self.terms)))
        for own, m in zip(self.weights, models):
            own[np.searchsorted(self.terms, m.terms)] = m.weights[: len(m.terms)]
        self.shape = np.array([m.weights[len(m.terms) :] for m in models])
        self.bias = np.array([m.bias for m in models])

    def log_odds(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(models, rows): terms count once a document."""
        words = Words(body, offsets, ALNUM)
        out = self.shape @ shape(body, offsets, words).T + self.bias[:, None]
        if len(self.terms):
            row, found = words.row_of_word(), []
            for terms in _terms(words):
                at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
                hit = np.flatnonzero(self.terms[at] == terms)
                found.append(row[hit] * len(self.terms) + at[hit])
            pairs = np.unique(np.concatenate(found))
            rows, term = pairs // len(self.terms), pairs % len(self.terms)
            out = out + np.array([np.bincount(rows, weights=w[term], minlength=len(offsets) - 1) for w in self.weights])
        return np.clip(out, -30, 30)


def fit(chosen: np.ndarray, rows: np.ndarray, terms: np.ndarray, form: np.ndarray, y: np.ndarray) -> Model:
    """Fits the chosen terms (in order) and the shape by Newton steps; (rows, terms): who has which of them."""
    y = y.astype(np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:  # one class only: no evidence either way
        return Model(np.empty(0, np.uint32), np.zeros(SHAPE), -30.0 if not n1 else 30.0)
    x = np.zeros((len(y), len(chosen) + SHAPE + 1))
    if len(chosen):
        at = np.minimum(np.searchsorted(chosen, terms), len(chosen) - 1)
        have = chosen[at] == terms
        x[rows[have], at[have]] = 1
    x[:, len(chosen) : -1] = form
    x[:, -1] = 1
    ridge = np.full(x.shape[1], 0.3)
    ridge[len(chosen) : -1] = 0.02
    ridge[-1] = 1e-4
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return Model(chosen, w[:-1], float(w[-1]))


def _standing_out(counts: DataFrame, own: str, n1: int, n0: int, most: int) -> np.ndarray:
    """The terms (term, n, low, toxic) whose log-odds differ most between n1 and n0 rows, by their standard error, in order."""
    c1, c0 = F.col(own), F.col("n") - F.col(own)
    parts = [c1 + 0.5, n1 - c1 + 0.5, c0 + 0.5, n0 - c0 + 0.5]
    z = F.abs(F.log(parts[0] / parts[1]) - F.log(parts[2] / parts[3])) / F.sqrt(1 / parts[0] + 1 / parts[1] + 1 / parts[2] + 1 / parts[3])
    best = counts.where("n >= 5").select("term", z.alias("z")).where("z > 3.0").orderBy(F.desc("z"), "term").limit(most).collect()
    return np.sort(np.array([r["term"] for r in best], np.int64).astype(np.uint32))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: int = MOST_LABELLED, most_terms: int = MOST_TERMS) -> tuple[Model, Model]:
    """(low quality, toxic): fitted on at most ``most`` labelled rows, each over at most ``most_terms`` terms."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).dropna()
    known = known.groupBy("_id").agg(F.min("q").alias("q"), F.max("t").alias("t")).orderBy(F.xxhash64("_id", F.lit(9)), "_id").limit(most)
    rows = known.join(docs.select(F.col(doc_id).alias("_id"), text_of(docs, text).alias("x")), "_id")
    features = cut(rows.select("_id", F.when(F.col("q") == 0, 1).otherwise(0).alias("low"), F.when(F.col("t") != 0, 1).otherwise(0).alias("toxic"), "x").mapInArrow(_features, _FEATURES))
    n, low, toxic = features.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        none = Model(np.empty(0, np.uint32), np.zeros(SHAPE), -30.0)
        return none, none
    counts = cut(features.mapInArrow(_term_counts, "term long, n long, low long, toxic long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "low", "toxic")]))
    chosen = [_standing_out(counts, own, ones, n - ones, most_terms) for own, ones in (("low", low), ("toxic", toxic))]
    every = np.union1d(*chosen)

    def shortened(batches):
        for batch in batches:
            own = [np.frombuffer(t, np.uint32) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t[np.isin(t, every)].tobytes() for t in own], pa.binary()), batch.column(4)], names=batch.schema.names)

    # of each row its shape and which of the chosen terms it has
    held = features.mapInArrow(shortened, _FEATURES).collect()
    held.sort(key=lambda r: (r["id"], bytes(r["terms"]), bytes(r["form"])))
    parts = [np.frombuffer(r["terms"], np.uint32) for r in held]
    row, terms = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts)
    form = np.array([np.frombuffer(r["form"], np.float64) for r in held])
    return tuple(fit(own, row, terms, form, np.array([r[c] for r in held])) for own, c in zip(chosen, ("low", "toxic")))


_FEATURES = "id long, low int, toxic int, terms binary, form binary"


def _features(batches):
    for batch in batches:
        terms, forms = [], []
        for low, high, body, offsets in slices(batch.column(3)):
            words = Words(body, offsets, ALNUM)
            rows, found = document_terms(words)
            bounds = np.searchsorted(rows, np.arange(high - low + 1))
            form = shape(body, offsets, words)
            for i in range(high - low):
                terms.append(found[bounds[i] : bounds[i + 1]].tobytes())
                forms.append(form[i].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *batch.columns[1:3], pa.array(terms, pa.binary()), pa.array(forms, pa.binary())], names=["id", "low", "toxic", "terms", "form"])


def _term_counts(batches):
    """A batch's counts of each term: rows that have it, and how many of these are of low quality, or toxic."""
    for batch in batches:
        parts = [np.frombuffer(t, np.uint32) for t in batch.column(3).to_pylist()]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        terms, number = np.unique(np.concatenate([np.empty(0, np.uint32), *parts]), return_inverse=True)
        sums = [np.bincount(number, weights=batch.column(i).to_numpy()[row], minlength=len(terms)).astype(np.int64) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(np.bincount(number, minlength=len(terms)).astype(np.int64)), *map(pa.array, sums)], names=["term", "n", "low", "toxic"])


def score(docs: DataFrame, models: tuple[Model, Model], *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct (low, toxic) of each document's own log-odds, and its name."""
    spark = prepare(docs.sparkSession)
    held, name, at = spark.sparkContext.broadcast(Scorer(models)), free_name(docs, "evidence"), docs.columns.index(text)
    kind = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("toxic", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            odds = np.concatenate([np.empty((2, 0)), *[held.value.log_odds(body, offsets) for _, _, body, offsets in slices(batch.column(at))]], axis=1)
            result = pa.StructArray.from_arrays([pa.array(o) for o in odds], names=["low", "toxic"])
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=schema.names)

    return docs.mapInArrow(run, schema), name


def _probability(odds):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def site_rates(sums: DataFrame) -> tuple[DataFrame, float]:
    """((path, host_rate, path_rate), global rate) from (host, path, n, unfit), shrunk level by level."""
    hosts = sums.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("unfit").alias("hu"))
    # moments over hosts, one row: the mean rate, and the variance between hosts beyond what their counts alone give
    rate = F.col("hu") / F.col("hn")
    u, n, squares, k, nn = hosts.agg(F.sum("hu"), F.sum("hn"), F.sum(F.col("hn") * rate * rate), F.count("*"), F.sum(F.col("hn") * F.col("hn"))).first()
    if not n:
        return sums.select("path", F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate")), 0.5
    mean = min(max(u / n, 1e-4), 1 - 1e-4)
    between = max((squares - n * mean * mean - (k - 1) * mean * (1 - mean)) / max(n - nn / n, 1.0), 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6)
    host_rate = (F.col("hu") + strength * mean) / (F.col("hn") + strength)
    path_rate = (F.col("unfit") + strength * F.col("host_rate")) / (F.col("n") + strength)
    shrunk = sums.join(hosts, "host").withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    return shrunk.select("path", "host_rate", "path_rate"), mean


def _path(docs: DataFrame, host: str, path: str):
    """(host, path) keys; null is a value of its own."""
    h = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))
    return h, F.concat(h, F.lit("\n"), F.coalesce(F.concat(F.lit("="), F.col(path).cast("string")), F.lit("-")))


def classify(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", most: int = MOST_LABELLED, most_terms: int = MOST_TERMS, keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """docs, or their columns ``keep``, with a struct (low, toxic, host_rate, path_rate, log_odds, rejected), and its name."""
    models = train(docs, labels, doc_id=doc_id, text=text, most=most, most_terms=most_terms)
    keep = docs.columns if keep is None else keep
    h, p = _path(docs, host, path)
    scored, name = score(docs, models, text=text)
    site, salted = free_name(scored, "site"), free_name(scored, "site_salt")
    at = F.struct(h.alias("host"), p.alias("path")).alias(site)
    # every text is read into evidence once
    scored = cut(scored.select(*keep, name, at, F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int").alias(salted)))
    unfit = 1 - (1 - _probability(F.col(name)["low"])) * (1 - _probability(F.col(name)["toxic"]))
    sums = cut(scored.select(f"{site}.host", f"{site}.path", unfit.alias("p")).groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("unfit")))
    rates, mean = site_rates(sums)
    key, salt, result = free_name(scored, "site_path"), free_name(scored, "path_salt"), free_name(scored, "quality_class")
    rates = cut(rates).select(F.col("path").alias(key), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias(salt), F.struct("host_rate", "path_rate").alias(free_name(scored, "site_rates")))
    rate = rates.columns[-1]
    joined = scored.withColumn(key, F.col(site)["path"]).withColumnRenamed(salted, salt).join(rates, [key, salt])
    low, toxic = F.col(name)["low"], F.col(name)["toxic"]
    both = 1 - (1 - _probability(low)) * (1 - _probability(toxic))
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.log(both / F.greatest(1 - both, F.lit(1e-13)))))
    r = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(rate)["path_rate"]))
    lift = F.log(r / (1 - r)) - float(np.log(mean / (1 - mean)))
    posterior = odds + SITE_WEIGHT * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), lift))
    out = joined.withColumn(result, F.struct(low.alias("low"), toxic.alias("toxic"), F.col(rate)["host_rate"].alias("host_rate"), F.col(rate)["path_rate"].alias("path_rate"), posterior.alias("log_odds"), (posterior > 0).alias("rejected")))
    return out.select(*keep, result), result


def keep_fit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    made, name = classify(docs, labels, **options)
    return made.where(~F.col(name)["rejected"]).drop(name)
