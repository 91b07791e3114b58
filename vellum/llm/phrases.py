"""Phrase collocations: identical pieces once, n-grams counted by hash bucket, parts looked up.

1. Texts are cut into pieces; identical pieces of a language are one row with a
   multiplicity, so what many documents share is worked on once.
2. The n-grams of distinct pieces, weighted by multiplicity and summed up for each
   slice, are dealt out by hash.  Each bucket is counted by DuckDB within the task
   that has it: it reads the bucket as a stream and spills beyond ``COUNT_MEMORY`` to a
   folder that goes with the task.  What occurs fewer than ``least`` times leaves here.
   Words come first, then pairs, and so on: a phrase holds no rarer one than itself, so
   only runs of k words whose two runs of k - 1 words were kept are dealt out.  The kept ones
   reach all tasks as a bit filter of fixed size (8 MB); one that is full
   lets more through to be counted, and changes no result.
3. A phrase's parts are counted in other buckets than the phrase: it asks for them
   (``common.looked_up``), each bucket for each part once, however many phrases have it.

A phrase's score is that of its weakest cut; phrases that a longer one explains go; the
first ``top`` of each language are found in two steps, within partitions and of these.

Products of three counts pass 64 bits; they are decimals of 38 digits, which hold
``SCALE * a * a`` for all counts below 10^16.

Defined cases: a null text has no pieces, a null language is ``und``; texts of any length
are cut whole; repeated rows count as often as they come; equal scores go by count and
then by the phrase's bytes; an empty table gives no rows; only the two named columns are
read, whatever others are called.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, looked_up, prepare
from .kernels import LOWER, Words, grams, slices, substrings

MOST_WORDS, LEAST, SHARE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
COUNT_MEMORY = "256MB"
FILTER_BITS = 26
_CUTS, _BLANKS = "[.,;:!?\\n\\x0b\\x0c\\r]", "[ \\t]+"
_NOT_SPACE = np.arange(256) != 0x20


def _pieces(langs: pa.Array, texts: pa.Array) -> Iterator[pa.Table]:
    """(lang, piece, n): distinct pieces of each slice, their words joined by one space."""
    for low, high, body, offsets in slices(texts):
        lowered = pa.StringArray.from_buffers(high - low, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(LOWER[body]))
        split = pc.split_pattern_regex(lowered, _CUTS)
        parts = pc.utf8_trim(pc.replace_substring_regex(split.flatten(), _BLANKS, " "), " ")
        each = pa.table({"lang": langs.slice(low, high - low).take(pc.list_parent_indices(split)), "piece": parts})
        each = each.filter(pc.not_equal(each["piece"], ""))
        yield each.group_by(["lang", "piece"]).aggregate([([], "count_all")])


def distinct_pieces(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, piece, n)."""

    def run(batches):
        for batch in batches:
            for made in _pieces(batch.column(0), batch.column(1)):
                yield from made.rename_columns(["lang", "piece", "n"]).to_batches()

    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")
    return named.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _hashes(words: Words, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    own = words.hashes()
    return own if k == 1 else grams(own, k)


def _let_through(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bit_filter(counted: DataFrame, k: int) -> np.ndarray:
    """2 ** FILTER_BITS bits, set for the grams (k words each) of counted: as many bytes whatever it holds."""

    def run(batches):
        for batch in batches:
            for _, _, body, offsets in slices(batch.column(0)):
                words = Words(body, offsets, _NOT_SPACE, lower=False)
                slot = _hashes(words, k)[words.rows[:-1]] & np.uint64((1 << FILTER_BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["cell", "bit"])

    cells = counted.select("gram").mapInArrow(run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint8)


def _grams(langs: pa.Array, pieces: pa.Array, n: np.ndarray, k: int, bits: np.ndarray | None) -> Iterator[pa.Table]:
    """(lang, gram, f): weighted runs of k words of the pieces of each slice, summed up; those that hold a shorter one that the filter stops left out."""
    for low, high, body, offsets in slices(pieces):
        words = Words(body, offsets, _NOT_SPACE, lower=False)
        row = words.row_of_word()
        first = np.arange(max(0, len(row) - k + 1))
        first = first[row[first] == row[first + k - 1]]
        if bits is not None:
            good = _let_through(bits, _hashes(words, k - 1))
            first = first[good[first] & good[first + 1]]
        start = words.starts[first]
        own = low + row[first]
        each = pa.table({"lang": langs.take(pa.array(own)), "gram": substrings(body, start, words.ends[first + k - 1] - start), "f": n[own]})
        sums = each.group_by(["lang", "gram"]).aggregate([("f", "sum")])
        yield pa.table({"lang": sums["lang"], "gram": sums["gram"], "f": sums["f_sum"]})


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of one hash bucket, of ``least`` or more."""
    import duckdb

    head = next(batches, None)
    if head is None:
        return
    grams = pa.RecordBatchReader.from_batches(head.schema, itertools.chain([head], batches))
    with tempfile.TemporaryDirectory(prefix="grams-") as spill:
        config = {"memory_limit": COUNT_MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False}
        with duckdb.connect(config=config) as con:
            sums = con.from_arrow(grams).aggregate("lang, gram, CAST(sum(f) AS BIGINT) AS f", "lang, gram").filter(f"f >= {int(least)}")
            yield from sums.to_arrow_reader(1 << 16)


def phrase_counts(pieces: DataFrame, most: int = MOST_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, gram, words, f): how often each run of up to ``most`` words occurs in pieces (lang, piece, n), if ``least`` times or more."""
    schema, levels, bits = "lang string, gram string, f long", [], None
    for k in range(1, most + 1):
        held = pieces.sparkSession.sparkContext.broadcast(bits)

        def unfold(batches, k=k, held=held):
            for batch in batches:
                for made in _grams(batch.column(0), batch.column(1), batch.column(2).to_numpy(), k, held.value):
                    yield from made.to_batches()

        grams_of_k = pieces.select("lang", "piece", "n").mapInArrow(unfold, schema).repartition("lang", "gram")
        levels.append(cut(grams_of_k.mapInArrow(lambda batches: _count(batches, least), schema)))
        bits = _bit_filter(levels[-1], k) if k < most else None
    return reduce(DataFrame.union, [c.select("lang", "gram", F.lit(k + 1).alias("words"), "f") for k, c in enumerate(levels)])


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of counts' phrases of two words or more: the cut with the lowest score, the first of equals."""
    spaced = counts.where("words > 1").select("lang", F.col("gram").alias("phrase"), "words", F.col("f").alias("a"), F.split("gram", " ").alias("w"))
    cuts = spaced.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    asked = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for column, count in (("first", "l"), ("rest", "r")):
        asked = looked_up(asked, ["lang", column], ["phrase"], counts.select("lang", F.col("gram").alias(column), F.col("f").alias(count)), [count])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.call_function("div", F.lit(scale).cast("decimal(38,0)") * whole("a") * whole("a"), whole("l") * whole("r"))
    weakest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r"))
    return asked.groupBy("lang", "phrase", "words", "a").agg(weakest.alias("b")).select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def independent(phrases: DataFrame, most: int = MOST_WORDS, share: int = SHARE) -> DataFrame:
    """phrases (lang, phrase, words, a) without those that lie in a longer one with ``share`` per cent of their count or more."""
    longer = phrases.where("words > 2").select("lang", "words", F.col("a").alias("b"), F.split("phrase", " ").alias("w"))
    inner = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    around = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("b").alias("_around"))
    joined = phrases.join(around, ["lang", "phrase"], "left")
    return joined.where(F.coalesce(F.col("_around") * 100 < F.col("a") * share, F.lit(True))).drop("_around")


def best(phrases: DataFrame, top: int = TOP, parts: int = 64) -> DataFrame:
    """phrases with their rank from 1 in their language, the first ``top``; no task orders more than parts * top rows of a language but in partitions."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    dealt = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("_part", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", most: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``most`` words that occur ``least`` times or more."""
    prepare(docs.sparkSession)
    pieces = cut(distinct_pieces(docs, lang, text))
    in_piece = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = pieces.groupBy("lang").agg(F.sum(F.col("n") * in_piece).alias("n"))
    phrases = cut(scored(phrase_counts(pieces, most, least)))
    return best(independent(phrases, most, share), top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
