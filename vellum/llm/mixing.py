"""Mixing of sources to target weights.

Each source's words are packed into blocks of BLOCK words.  A source's target
gives its number of slots.  Output shards draw how many of their slots each
source fills from a multinomial, conditioned on the sources' slot numbers so that
the whole mix meets the targets.  Shards are drawn in strata of STRATUM_SLOTS slots,
to each of which every source gives its even share, one stratum to a task; a mix of
any size has as many strata as it fills.  A slot's number goes through its source's
pseudorandom permutation, one epoch after another, to the number of the block
that fills it, and slots join blocks by (source, number): even keys, however
large one source is.

Packing needs running sums within sources of any size.  Documents fall into
groups by a hash of their id, a number that grows with the table; sums over a
group are small, their running sums (in two levels) give each group its first block,
and running sums within a group do the rest.  A group's last block may be short.

One row for each source is held by the driver: weights are given by the place of a
source's name among all names, so the names are few by the operator's own terms.

Defined cases: a null text or one without words has size 0, is packed nowhere and
taken 0 times; the null source is a source of its own, the last; repeated rows
are separate rows; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, prepare, running_starts
from .kernels import NONSPACE, Words, slices

BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Slots of an output shard, and rows of a group of documents, on average.
SHARD_SLOTS, GROUP_ROWS = 1 << 16, 1024
#: Slots of shards that are drawn together, about, and slots that one row unfolds to.
STRATUM_SLOTS, RUN = 1 << 28, 1 << 16


def word_counts(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """docs with the number of words in place of the text."""
    at = docs.columns.index(text)
    keep = [i for i in range(len(docs.columns)) if i != at]
    schema = T.StructType([*[docs.schema.fields[i] for i in keep], T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            sizes = [Words(body, offsets, NONSPACE, lower=False).counts for _, _, body, offsets in slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(np.concatenate([np.empty(0, np.int64), *sizes]), pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def source_targets(sizes: list[int], weights=WEIGHTS, cap: float = CAP) -> list[float]:
    """Words to take of each source, in order: all words shared by weight, at most ``cap`` times a source's own.

    What is above a source's most goes to the others by weight, again and again.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weight[i] for i in free)
        above = {i for i in free if left * weight[i] / total > cap * sizes[i]}
        if not above:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in above:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in above)
        free -= above
    return out


def shard_counts(slots: list[int], shards: int, seed: list[int]) -> np.ndarray:
    """(shards, sources): multinomial draws given that each source's slots sum up."""
    left = np.array(slots, np.int64)
    rng, out = np.random.default_rng(seed), []
    for size in np.diff(np.linspace(0, left.sum(), shards + 1).astype(np.int64)):
        out.append(rng.multivariate_hypergeometric(left, size, method="marginals") if size else np.zeros(len(slots), np.int64))
        left = left - out[-1]
    return np.array(out).reshape(shards, len(slots))


def strata(slots: list[int], most: int) -> int:
    return max(1, math.ceil(sum(slots) / most))


def stratum_runs(stratum: int, of: int, slots: list[int], blocks: list[int], shard_slots: int, seed: int) -> Iterator[tuple]:
    """(shard, source_no, epoch, first, last, n, a, b) of a stratum's shards: runs of a source's slots, cut at the epochs' ends."""
    first = [n * stratum // of for n in slots]
    shards = max(1, math.ceil(sum(slots) / of / shard_slots))  # strata differ by less than a slot of each source
    counts = shard_counts([n * (stratum + 1) // of - f for n, f in zip(slots, first)], shards, [seed, stratum])
    for shard, own in enumerate(counts, stratum * shards):
        for s, n in enumerate(own.tolist()):
            while n:
                epoch = first[s] // blocks[s]
                take = min(n, (epoch + 1) * blocks[s] - first[s])
                yield (shard, s, epoch, first[s], first[s] + take - 1, blocks[s], *_permutation(blocks[s], seed, s, epoch))
                first[s], n = first[s] + take, n - take


def _permutation(n: int, seed: int, source: int, epoch: int) -> tuple[int, int]:
    """(multiplier, offset) of a keyed permutation x -> (multiplier * x + offset) mod n."""
    rng = np.random.default_rng([seed, source, epoch])
    while True:
        a = int(rng.integers(1, max(2, n)))
        if math.gcd(a, n) == 1 and (n < 8 or min(a, n - a) > math.isqrt(n) // 2):
            return a, int(rng.integers(0, n))


class Mix:
    """A mix of a table (doc_id, source, size): ``rows`` has its packed documents, ``sources`` one dict for each source."""

    def __init__(self, rows: DataFrame, sources: list[dict], slots: list[int], seed: int):
        self.rows, self.sources, self.source_slots, self.seed = rows, sources, slots, seed
        self.spark = rows.sparkSession

    def slots(self) -> DataFrame:
        """(shard, source_no, slot, epoch, block): every slot of the mix with the number of the block that fills it."""
        own, blocks, seed, shard_slots = self.source_slots, [s["blocks"] for s in self.sources], self.seed, SHARD_SLOTS
        of, names = strata(own, STRATUM_SLOTS), ["shard", "source_no", "epoch", "first", "last", "n", "a", "b"]

        def run(batches):
            for batch in batches:
                for stratum in batch.column(0).to_pylist():
                    rows = list(stratum_runs(stratum, of, own, blocks, shard_slots, seed))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], names=names)

        frame = self.spark.range(0, of, 1, of).mapInArrow(run, ", ".join(f"{n} long" for n in names))
        frame = frame.withColumn("source_no", F.col("source_no").cast("int")).withColumn("epoch", F.col("epoch").cast("int"))
        frame = frame.withColumn("low", F.explode(F.sequence("first", "last", F.lit(RUN))))
        frame = frame.repartition("source_no", "low")
        each = frame.select("shard", "source_no", "epoch", "n", "a", "b", F.explode(F.sequence("low", F.least(F.col("low") + (RUN - 1), "last"))).alias("slot"))
        # a decimal product: a * slot can pass 64 bits
        product = F.col("a").cast("decimal(19,0)") * (F.col("slot") % F.col("n")).cast("decimal(19,0)")
        return each.select("shard", "source_no", "slot", "epoch", F.pmod(product + F.col("b"), F.col("n")).cast("long").alias("block"))

    def segments(self) -> DataFrame:
        """(doc, doc_id, source_no, block, first_word, n_words): the parts of documents in blocks."""
        r = self.rows.where("size > 0").withColumn("block_in", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))))
        low = F.greatest(F.col("block_in") * BLOCK, F.col("start"))
        high = F.least((F.col("block_in") + 1) * BLOCK, F.col("start") + F.col("size"))
        return r.select("doc", "doc_id", "source_no", (F.col("first_block") + F.col("block_in")).alias("block"), (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))

    def mixture(self) -> DataFrame:
        """The mix: (shard, slot, epoch, source_no, block, doc, doc_id, first_word, n_words), joined by block number."""
        return self.slots().join(self.segments().hint("merge"), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """The packed rows with the words that the mix takes of each, repeats counted."""
        uses = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        # all three grow with the table: none is broadcast, however small its files look
        words = self.segments().join(uses.hint("merge"), ["source_no", "block"]).groupBy("doc").agg(F.sum(F.col("uses") * F.col("n_words")).alias("taken"))
        return self.rows.join(words.hint("merge"), "doc", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, cap: float = CAP, seed: int = 20) -> Mix:
    """Packs docs and draws their mix."""
    spark = prepare(docs.sparkSession)
    sized = word_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")))
    sized = cut(sized)
    n_groups = max(1, sized.count() // GROUP_ROWS)
    grouped = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size"), F.lit(n_groups)))
    sums = cut(grouped.groupBy("source", "grp").agg(F.sum("size").alias("words"), F.count("*").alias("n")).withColumn("own_blocks", F.ceil(F.col("words") / F.lit(BLOCK))))
    # one row for each source: names are few against documents, and needed in order
    named = sums.groupBy("source").agg(F.sum("words").alias("size"), F.sum("own_blocks").alias("blocks")).collect()
    named = sorted(named, key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = source_targets([r["size"] for r in named], weights, cap)
    sources = [{"source": r["source"], "size": int(r["size"]), "blocks": int(r["blocks"]), "target": t} for r, t in zip(named, targets)]
    slots = [min(int(cap) * s["blocks"], round(s["target"] / (s["size"] / s["blocks"]))) if s["size"] else 0 for s in sources]
    table = spark.createDataFrame([(i, s["source"], s["size"], s["target"]) for i, s in enumerate(sources)], "source_no int, _source string, source_size long, target double")
    starts = running_starts(sums, ["source"], "grp", "own_blocks", "first_block").select(F.col("source").alias("_s"), F.col("grp").alias("_g"), "first_block")
    starts = starts.join(table, F.col("_s").eqNullSafe(F.col("_source"))).drop("_source")
    within = Window.partitionBy("source", "grp").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordinal = F.row_number().over(Window.partitionBy("source", "grp").orderBy("doc_id", "size"))
    packed = grouped.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("ordinal", ordinal)
    packed = packed.join(starts.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("grp") == F.col("_g")))
    doc = F.struct("source_no", "grp", "ordinal").alias("doc")
    rows = cut(packed.select(doc, "doc_id", "source", "source_no", "size", "start", "first_block", "source_size", "target"))
    return Mix(rows, sources, slots, seed)


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", seed: int = 20, **options) -> DataFrame:
    """Whole documents in the mix's proportions, with their own columns.

    A document comes as many times as the mix takes its words, its last part drawn
    by a seeded hash: taken 2.4 times, it comes twice or, in 4 cases of 10, thrice.
    Rows that share an id share that number.  A document without words has no part
    in any target and comes once.
    """
    made = mix(docs, doc_id=doc_id, seed=seed, **options).taken()
    times = F.col("taken") / F.col("size")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    per_id = made.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    mixed_id, copies, copy = (free_name(docs, n) for n in ("mixed_id", "copies", "copy"))
    number = F.when(F.col("size") == 0, 1).otherwise(F.floor(times) + F.when(times - F.floor(times) > draw, 1).otherwise(0)).cast("int")
    per_id = per_id.select(F.col("doc_id").alias(mixed_id), number.alias(copies)).where(F.col(copies) > 0)
    joined = docs.join(per_id.hint("merge"), docs[doc_id].eqNullSafe(F.col(mixed_id)))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
