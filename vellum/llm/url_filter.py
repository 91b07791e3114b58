"""URL filter by the likelihood ratio of two character models, one of accepted URLs and one of rejected ones.

Models are Markov chains of variable order: a character's probability after the longest
context that the class has seen, mixed by Witten and Bell's rule with that after each
shorter one, down to an even share of ``ALPHABET``.  A URL's score is the difference of
its log-likelihoods under both, divided by its characters and its end mark.

All labelled URLs are counted, as often as they come, in two folds by a hash of their
``group``, so that a host is in one.  Three pairs of models come of the same counts: of both folds,
for URLs without a label, and of either fold alone, for the labelled URLs of the other.
The scores of these calibrate the threshold: the one with the best mean of the
accepted share above it and the rejected share below it, over a histogram of at most
2 * HALF_BINS bars.

Counts are kept for each distinct string of ORDER + 1 characters, which each position
has as starts are filled up; shorter ones are sums over their endings.  Tables grow
with the strings that the URLs hold, and are never gathered: a string asks for the counts of its
endings, and a URL for the ratios of its strings, by ``common.looked_up``.  Ratios are whole
numbers of 2^-20, so sums don't depend on their order.

Defined cases: a null URL is an empty one, which has its end mark alone; characters are
code points; URLs of any length count whole; a label other than the rest of a URL's rows
stays with its row; without accepted, or without rejected URLs, all unlabelled ones get
the other class's verdict, and without both they are allowed; ties of the threshold go to
the one nearest to 0; an empty table gives no rows; other columns stay, and the new one
takes a name that none of them has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, looked_up, prepare
from .kernels import slices, substrings

ORDER, ALPHABET = 4, 256
START, END = "\x02", "\x03"
UNIT, BIN, HALF_BINS = 1 << 20, 1 << 14, 512
BOTH = 2
_MODELS = [(kind, model) for kind in "ar" for model in (0, 1, BOTH)]


def _strings(padded: pa.Array, order: int):
    """(first row, rows, strings): all runs of order + 1 characters of each slice, and the row of each."""
    for low, high, body, offsets in slices(padded):
        lead = np.flatnonzero((body & 0xC0) != 0x80)
        ends, bounds = np.append(lead[1:], len(body)), np.searchsorted(lead, offsets)
        each = np.maximum(np.diff(bounds) - order, 0)
        row = np.repeat(np.arange(high - low), each)
        at = bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        yield low + row, substrings(body, lead[at], ends[at + order] - lead[at])


def _distinct_urls(pages: DataFrame, url: str, label: Column, group: Column) -> DataFrame:
    """(id, url, padded, mode, a0, a1, r0, r1): each URL once, the counts of its labels by fold, and the pair of models that is to score it."""
    fold = F.pmod(F.xxhash64("group"), F.lit(2)).cast("int")
    named = pages.select(F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(group.cast("string"), F.lit("")).alias("group"), label.alias("label"))
    once = named.groupBy("url").agg(F.min("group").alias("group"), F.count_if("label").alias("a"), F.count_if(~F.col("label")).alias("r")).withColumn("fold", fold)
    own = [F.when(F.col("fold") == f, F.col(c)).otherwise(0).alias(f"{c}{f}") for c in "ar" for f in (0, 1)]
    mode = F.when(F.col("a") + F.col("r") > 0, F.col("fold")).otherwise(BOTH)
    return once.select(F.monotonically_increasing_id().alias("id"), "url", mode.alias("mode"), *own)


def _padded(urls: DataFrame, order: int) -> DataFrame:
    return urls.withColumn("padded", F.concat(F.lit(START * order), "url", F.lit(END)))


_COUNTS = ("a0", "a1", "r0", "r1")


def string_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(s, a0, a1, r0, r1): each string of order + 1 characters of urls, and its weight by class and fold; 0 where only unlabelled URLs have it."""

    def run(batches):
        for batch in batches:
            weights = [c.to_numpy() for c in batch.columns[1:]]
            for row, strings in _strings(batch.column(0), order):
                sums = pa.table({"s": strings, **{c: w[row] for c, w in zip(_COUNTS, weights)}}).group_by("s").aggregate([(c, "sum") for c in _COUNTS])
                yield from sums.rename_columns(["s", *_COUNTS]).to_batches()

    made = _padded(urls, order).select("padded", *_COUNTS).mapInArrow(run, "s string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return made.groupBy("s").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _endings(strings: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each ending of s, from one character (k = 0) to all."""
    each = strings.select("s", *keep, F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"))
    return each.withColumn("gram", F.substring("s", F.lit(order + 1) - F.col("k"), F.col("k") + 1))


def gram_stats(strings: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, and for each class and model: n its count, c its context's, t the distinct characters after that)."""
    # a model that scores fold 0 counts fold 1 alone, and the other way round
    seen = {(k, m): F.col(f"{k}0") + F.col(f"{k}1") if m == BOTH else F.col(f"{k}{1 - m}") for k, m in _MODELS}
    grams = _endings(strings, order, *_COUNTS).groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    grams = cut(grams.select("gram", F.substring("gram", F.lit(1), F.length("gram") - 1).alias("context"), *[v.alias(f"n_{k}{m}") for (k, m), v in seen.items()]))
    sums = [x for k, m in _MODELS for x in (F.sum(f"n_{k}{m}").alias(f"c_{k}{m}"), F.count_if(F.col(f"n_{k}{m}") > 0).alias(f"t_{k}{m}"))]
    return grams.join(grams.groupBy("context").agg(*sums), "context").drop("context")


def string_ratios(strings: DataFrame, stats: DataFrame, order: int = ORDER) -> DataFrame:
    """(s, q0, q1, q2): the log ratio of s's last character after the rest, accepted over rejected, under each pair of models, in units of 2^-20."""
    values = [c for c in stats.columns if c != "gram"]
    levels = looked_up(_endings(strings, order), ["gram"], ["s"], stats, values)
    name = [f"{k}{m}" for k, m in _MODELS]
    by_length = F.array_sort(F.collect_list(F.struct("k", *[F.col(v).cast("double").alias(v) for v in values])))

    def step(p, x):
        mixed = lambda i: F.when(x[f"c_{i}"] > 0, (x[f"n_{i}"] + x[f"t_{i}"] * p[i]) / (x[f"c_{i}"] + x[f"t_{i}"])).otherwise(p[i])
        return F.struct(*[mixed(i).alias(i) for i in name])

    start = F.struct(*[F.lit(1.0 / ALPHABET).alias(i) for i in name])
    folded = levels.groupBy("s").agg(by_length.alias("levels")).select("s", F.aggregate("levels", start, step).alias("p"))
    ratio = lambda m: F.round((F.ln(F.col(f"p.a{m}")) - F.ln(F.col(f"p.r{m}"))) * UNIT).cast("long")
    return folded.select("s", *[ratio(m).alias(f"q{m}") for m in (0, 1, BOTH)])


def url_scores(urls: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """(id, score): the mean log ratio of each URL's characters and end mark, in units of 2^-20, rounded down."""

    def run(batches):
        for batch in batches:
            ids, modes = (batch.column(i).to_numpy() for i in (0, 1))
            for row, strings in _strings(batch.column(2), order):
                each = pa.table({"id": ids[row], "mode": modes[row], "s": strings}).group_by(["id", "mode", "s"]).aggregate([([], "count_all")])
                yield from each.rename_columns(["id", "mode", "s", "times"]).to_batches()

    asked = _padded(urls, order).select("id", F.col("mode").cast("int").alias("mode"), "padded").mapInArrow(run, "id long, mode int, s string, times long")
    found = looked_up(asked, ["s"], ["id"], ratios, ["q0", "q1", "q2"])
    own = F.when(F.col("mode") == 0, F.col("q0")).when(F.col("mode") == 1, F.col("q1")).otherwise(F.col("q2"))
    return found.groupBy("id").agg(F.sum(own * F.col("times")).alias("sum"), F.sum("times").alias("n")).select("id", F.floor(F.col("sum") / F.col("n")).cast("long").alias("score"))


def threshold(scored: DataFrame) -> int | None:
    """The least score of an accepted URL that tells labelled ones (score, a, r) apart best; None if a class has none."""
    bar = F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(HALF_BINS - 1)), F.lit(-HALF_BINS)).cast("int")
    bars = sorted(scored.groupBy(bar.alias("bar")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).collect())  # 2 * HALF_BINS at most
    a, r = sum(b.a for b in bars), sum(b.r for b in bars)
    if not a or not r:
        return None
    below_a = below_r = 0
    held = {b.bar: b for b in bars}
    options = []
    for at in range(-HALF_BINS, HALF_BINS + 1):
        # accepted ones from this bar on, rejected ones before it; in whole numbers
        options.append(((a - below_a) * r + below_r * a, -abs(at), at))
        if at in held:
            below_a, below_r = below_a + held[at].a, below_r + held[at].r
    return max(options)[2] * BIN


def judged(pages: DataFrame, label: Column, group: Column, *, url: str = "url", order: int = ORDER) -> tuple[DataFrame, str]:
    """pages with a struct (allow, score), and its name.

    label: true for accepted rows, false for rejected ones, null where the models are to
    judge; group: what must not be on both sides of the calibration, such as the host.
    The score, in nats a character, is null for rows with a label.
    """
    prepare(pages.sparkSession)
    name, row, key = (free_name(pages, n) for n in ("judgement", "row", "key"))
    urls = cut(_distinct_urls(pages, url, label, group))
    strings = cut(string_counts(urls, order))
    ratios = cut(string_ratios(strings, cut(gram_stats(strings, order)), order))
    scored = cut(urls.join(url_scores(urls, ratios, order), "id").select("url", "score", (F.col("a0") + F.col("a1")).alias("a"), (F.col("r0") + F.col("r1")).alias("r")))
    labelled = scored.where("a + r > 0")
    least = threshold(labelled)
    if least is None:
        any_rejected = labelled.where("r > 0").limit(1).count() > 0
        allow = F.lit(not any_rejected)
    else:
        allow = F.col("_score") >= least
    # rows of one URL fall into buckets by their number
    numbered = pages.withColumn(row, F.monotonically_increasing_id()).withColumn(key, F.coalesce(F.col(url).cast("string"), F.lit("")))
    found = looked_up(numbered, [key], [row], scored.select(F.col("url").alias(key), F.col("score").alias("_score")), ["_score"])
    verdict = F.struct(F.coalesce(label, allow).alias("allow"), F.when(label.isNull(), F.col("_score") / float(UNIT)).alias("score"))
    return found.select(*[F.col(f"`{c}`") for c in pages.columns], verdict.alias(name)), name
