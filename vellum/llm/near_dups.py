"""Near-duplicate groups by one-permutation MinHash.

One hash of each shingle gives both its bin (the top bits) and its value; a bin
keeps its smallest value.  Empty bins borrow from full ones by optimal
densification: a hash of (bin, attempt) names the bin to try next, the same for
all documents.  BANDS bands of ROWS bins make the bucket keys: at a similarity of
0.8 a band agrees with probability 0.26, and none of 42 with 3 in a million.

A signature of two bits for each of SIGNATURE_BINS bins leaves out most chance
candidates, of any size alike: by a bound that no link can break, and by an
estimate that has to be SLACK points under the asked similarity.  By Hoeffding's
inequality (1024 bins, each off by half a point of its one bit) that turns away a
link with a probability under 2e-9, a thousandth of what the bands lose.

Texts with equal shingle sets are one class, and only classes meet in buckets.
Within a bucket candidates form a star around its smallest class, so a bucket of
n gives n-1 pairs.  Candidates are confirmed on full shingle sets; confirmed
links join components.  In buckets that then still hold several components all
pairs of different components meet, so a link is lost to the bands or the signature
only.  They meet in blocks of BLOCK members, two at a time, as arrays of signatures
in a task: a pair becomes a row only if its signatures allow a link.  Members of a
bucket's largest component meet those outside it, not each other.  The work is
quadratic in the members outside, by nature of the question; its memory is that of
two blocks, and it spreads over all tasks.

A star's centre is copied to as many salted parts as its members need; members
stream past it.

Defined cases: a text without words has the empty set, links with nothing and is
kept; one with fewer words than a shingle has its whole word sequence as its one
shingle; repeated rows are copies with the same id, each with its own result row;
rows that share an id but not the text belong to the groups of their own texts; a
null id belongs to no group; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, prepare
from .graph import components, joined_components
from .kernels import NONSPACE, U64, Words, mix64, shingle_sets, slices

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
#: Bins of a signature, and percentage points below the asked similarity down to which its estimate lets a pair through.
SIGNATURE_BINS, SLACK = 1024, 20
#: Members that one copy of a star's centre meets, members of one block of a bucket, and pairs whose signatures are compared at once.
STAR, BLOCK, PAIRS = 256, 1024, 8192


def _donors() -> np.ndarray:
    """donors[bin, attempt]: the bins that an empty bin tries in turn, a pseudorandom row of bins, then all bins."""
    tries = mix64((np.arange(BINS, dtype=U64)[:, None] << U64(32)) + np.arange(1, 8 * BINS + 1, dtype=U64)) % U64(BINS)
    return np.concatenate([tries, np.tile(np.arange(BINS, dtype=U64), (BINS, 1))], axis=1).astype(np.int64)


_DONORS = _donors()
_SHIFT = U64(64 - (BINS - 1).bit_length())


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, BINS) smallest values, densified; rows of empty sets are meaningless.

    values: sorted distinct shingle hashes of all documents; sorted hashes of one
    document are sorted by bin, so each bin's first is its smallest.
    """
    n = len(bounds) - 1
    out, full = np.zeros((n, BINS), U64), np.zeros((n, BINS), bool)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    spot = doc * BINS + (values >> _SHIFT).astype(np.int64)
    first = np.ones(len(spot), bool)
    first[1:] = spot[1:] != spot[:-1]
    out.ravel()[spot[first]] = values[first]
    full.ravel()[spot[first]] = True
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        donor = _DONORS[bin_, attempt]
        got = full[row, donor]
        out[row[got], bin_[got]] = out[row[got], donor[got]]
        row, bin_, attempt = row[~got], bin_[~got], attempt + 1
    return out


def _band_keys(sketch: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket keys."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(sketch), BANDS)).copy()
    parts = sketch[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS)
    for k in range(ROWS):
        key = mix64(key + parts[:, :, k])
    return key


def _signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, 2 * SIGNATURE_BINS / 64): which of its bins a set fills, and a random bit of the smallest value of each."""
    n, shift = len(bounds) - 1, U64(64 - (SIGNATURE_BINS - 1).bit_length())
    spot = np.repeat(np.arange(n), np.diff(bounds)) * SIGNATURE_BINS + (values >> shift).astype(np.int64)
    first = np.ones(len(spot), bool)
    first[1:] = spot[1:] != spot[:-1]
    full, bits = np.zeros(n * SIGNATURE_BINS, np.uint8), np.zeros(n * SIGNATURE_BINS, np.uint8)
    full[spot[first]] = 1
    bits[spot[first]] = mix64(values[first] ^ U64(0xC2B2AE3D27D4EB4F)) >> U64(63)
    return np.concatenate([np.packbits(x.reshape(n, -1), axis=1).view(np.int64) for x in (full, bits)], axis=1)


_SKETCH = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def _sketch_map(shingle: int):
    def run(batches):
        for batch in batches:
            for low, high, body, offsets in slices(batch.column(1)):
                values, bounds = shingle_sets(Words(body, offsets, NONSPACE), shingle)
                sizes = np.diff(bounds)
                some = sizes > 0
                sketch = sketches(values, bounds)[some]
                keys, signs = _band_keys(sketch).view(np.int64), _signatures(values, bounds)[some]
                sums = [np.zeros(high - low, U64) for _ in range(2)]
                if some.any():
                    for out, salt in zip(sums, (U64(1), U64(0x51ED270B35C1D9F3))):
                        out[some] = np.add.reduceat(mix64(values ^ salt), bounds[:-1][some])
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int64())) for x in (keys, signs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(sizes, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    return run


def _apart_map(percent: int):
    """Streams rows (bucket, a, b, block, id, label, first, n, bits, bands) sorted by (bucket, a, b); gives the pairs of the blocks a and b
    of a bucket that are in different components, where sizes and signatures allow a link.  The bucket's first member has met the others.
    A pair is given by the first bucket that it shares: if it has no place there, one of them is that bucket's first."""

    def pairs(block, ids, labels, first, sizes, a, b):
        """Positions of the pairs worth a look at their signatures."""
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        here, there = sizes[left][:, None], sizes[right][None, :]
        fit = (labels[left][:, None] != labels[right][None, :]) & (np.minimum(here, there) * 100 >= np.maximum(here, there) * percent)
        fit[ids[left] == first], fit[:, ids[right] == first] = False, False
        if a == b:
            fit = np.triu(fit, 1)
        i, j = np.nonzero(fit)
        return left[i], right[j]

    def compared(batch):
        bucket, a, b, block, ids, labels, first, sizes = (batch.column(i).to_numpy() for i in range(8))
        bits, bands = (batch.column(i).flatten().to_numpy().view(U64).reshape(len(ids), -1) for i in (8, 9))
        starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        for low, high in zip(starts, np.append(starts[1:], len(ids))):
            x, y = pairs(block[low:high], ids[low:high], labels[low:high], first[low], sizes[low:high], a[low], b[low])
            for k in range(0, len(x), PAIRS):
                i, j = low + x[k : k + PAIRS], low + y[k : k + PAIRS]
                fit = may_link(sizes[i], sizes[j], bits[i], bits[j], percent)
                i, j = i[fit], j[fit]
                shared = bands[i, (bands[i] == bands[j]).argmax(axis=1)].view(np.int64)
                i, j = i[shared == bucket[low]], j[shared == bucket[low]]
                yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def results(batch):
        found = list(compared(batch)) if batch.num_rows else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["centre", "member"])

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            keys = [batch.column(i).to_numpy() for i in range(3)]
            whole = batch.num_rows
            while whole and all(k[whole - 1] == k[-1] for k in keys):  # the last group may go on
                whole -= 1
            yield from results(batch.slice(0, whole))
            held = batch.slice(whole)
        if held is not None:
            yield from results(held)

    return run


def _confirm_map(shingle: int, percent: int):
    """Streams rows sorted by star (centre, part), the centre's own row first; gives the confirmed links."""

    def run(batches):
        centre, held = None, np.empty(0, U64)
        for batch in batches:
            centres, owns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            left, right = [], []
            for low, high, body, offsets in slices(batch.column(4)):
                values, bounds = shingle_sets(Words(body, offsets, NONSPACE), shingle)
                for i in range(high - low):
                    own = values[bounds[i] : bounds[i + 1]]
                    if owns[low + i] == 0:
                        centre, held = centres[low + i], own.copy()
                        continue
                    assert centres[low + i] == centre
                    if min(len(own), len(held)) * 100 < percent * max(len(own), len(held)):
                        continue
                    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    both = int((held[at] == own).sum())
                    if 100 * both >= percent * (len(own) + len(held) - both):
                        left.append(centre)
                        right.append(batch.column(3)[low + i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (centre, member) whose full sets are as similar as asked for, as links (a, b)."""
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts"))
    members = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("own"), F.col("member").alias("id"))
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("own"), F.col("centre").alias("id"))
    rows = members.union(centres).join(texts, "id").select("centre", "part", "own", "id", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "centre", "part").sortWithinPartitions("centre", "part", "own").mapInArrow(_confirm_map(shingle, percent), "a long, b long")


def _may_link(percent: int):
    """may_link of the columns n, _n, bits, _bits."""
    half = SIGNATURE_BINS // 64
    total = lambda f: " + ".join(f"bit_count({f(i)})" for i in range(half))
    either, one = total(lambda i: f"bits[{i}] | _bits[{i}]"), total(lambda i: f"bits[{i}] ^ _bits[{i}]")
    shown = total(lambda i: f"bits[{i}] & _bits[{i}] & (bits[{i + half}] ^ _bits[{i + half}])")
    sizes = f"least(n, _n) * 100 >= greatest(n, _n) * {percent}"
    sure = f"{100 + percent} * (({one}) + ({shown})) <= {100 - percent} * (n + _n)"
    estimate = f"100 * (({one}) + 2 * ({shown})) <= {100 - percent + SLACK} * ({either})"
    return F.expr(f"{sizes} and {sure} and {estimate}")


def may_link(n: np.ndarray, _n: np.ndarray, bits: np.ndarray, _bits: np.ndarray, percent: int) -> np.ndarray:
    """Whether the signatures bits, _bits of pairs of sets of n and _n shingles allow a link.

    Each shingle that only one set has changes one bin at most, so no more bins differ
    than the (100 - percent) / (100 + percent) of n + _n shingles that a link allows.
    That is sure, but says little once most bins are full.  The estimate: of the bins
    that either fills, those filled by one only differ, and half of those that both
    fill with other values show it.
    """
    half = SIGNATURE_BINS // 64
    full, _full = bits[:, :half], _bits[:, :half]
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    one, both = count(full ^ _full), full & _full
    shown = count(both & (bits[:, half:] ^ _bits[:, half:]))
    sure = (100 + percent) * (one + shown) <= (100 - percent) * (n + _n)
    return sure & (100 * (one + 2 * shown) <= (100 - percent + SLACK) * (one + count(both)))


def _blocks():
    """Blocks of a bucket: outer for its members outside the largest component, which meet all blocks, and inner for that component, whose blocks needn't meet each other."""
    large, most = F.col("size") > BLOCK, F.col("most.size")
    of = lambda count: F.ceil(count / F.lit(BLOCK)).cast("int")
    return F.when(large, of(F.col("size") - most)).otherwise(1).alias("outer"), F.when(large, of(most)).otherwise(0).alias("inner")


def _groups(members: DataFrame, heads: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label): components of the similar members (bucket, id) of buckets; heads: (id, n, bits, bands)."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = heads.select(F.col("id").alias("centre"), F.col("n").alias("_n"), F.col("bits").alias("_bits"))
    stars = members.join(members.groupBy("bucket").agg(F.min("id").alias("centre")), "bucket").where("id <> centre").select("id", "centre").distinct()
    stars = cut(stars.join(heads.drop("bands"), "id").join(there, "centre").where(_may_link(percent)).select("centre", F.col("id").alias("member")))
    labels = components(cut(confirm(stars, texts, shingle, percent)))
    labelled = cut(members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")))
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    buckets = by_label.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("labels"), F.min("first").alias("first"), F.max(F.struct("size", "label")).alias("most"))
    # of two members one is the centre, and their pair is done
    open_ = buckets.where("labels > 1 and size > 2").select("bucket", "first", F.when(F.col("size") > BLOCK, F.col("most.label")).alias("largest"), *_blocks())
    left = labelled.join(open_, "bucket").withColumn("inside", F.coalesce(F.col("label") == F.col("largest"), F.lit(False)))
    own, every = F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")), F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    left = left.withColumn("block", (F.pmod(F.xxhash64("id"), own) + F.when(F.col("inside"), F.col("outer")).otherwise(0)).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), every - 1))).join(heads, "id")
    left = left.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "label", "first", "n", "bits", "bands")
    apart = left.repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(_apart_map(percent), "centre long, member long")
    return joined_components(labels, cut(confirm(cut(apart), texts, shingle, percent)))


def near_duplicate_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Rows are linked where 100 * intersection >= percent * union of their sets of
    ``shingle``-word shingles.
    """
    prepare(docs.sparkSession)
    body = F.col(text).cast("string")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
    sketched = cut(source.mapInArrow(_sketch_map(shingle), _SKETCH))
    same_set = ["n_shingles", "set_a", "set_b"]
    some = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # a class has a number of its own: rows that share an id can have different texts
    classes = some.groupBy(*same_set).agg(F.min(F.struct("doc_id", "text_hash", "bands", "bits")).alias("head")).select(*same_set, "head.*")
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    every = classes.select("id", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = cut(every.join(shared, "bucket").select("bucket", "id"))
    heads = classes.select("id", F.col("n_shingles").alias("n"), "bits", "bands")
    chosen = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_hash")
    texts = cut(source.join(chosen, ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "text"))
    labels = _groups(members, heads, texts, shingle, percent).withColumnRenamed("node", "id")
    labelled = classes.select("id", "doc_id", *same_set).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component"))
    heads = labelled.join(smallest, "label").select(*same_set, "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    joined = sketched.drop("bands", "bits").join(heads, same_set, "left")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their group, with their own columns.

    Of rows that repeat an id and a text, one; rows that share an id only are
    documents of their own, of which one stays where they are in one group.
    """
    ids = docs[doc_id].cast("long")
    name, options = free_name(docs, "near_id"), {"text": text, "shingle": shingle, "percent": percent}
    # a null id is in no group, and no copy of anything
    some, nameless = docs.where(ids.isNotNull()), docs.where(ids.isNull())
    if some.groupBy(ids.alias(name)).count().where("count > 1").limit(1).count():
        # numbers in order of ids, one for each id and text
        once = some.dropDuplicates([doc_id, text]).orderBy(ids, F.xxhash64(text))
        out = keep_one_of_each(cut(once.withColumn(name, F.monotonically_increasing_id())), doc_id=name, **options).drop(name)
    else:
        kept = cut(near_duplicate_groups(docs, doc_id=doc_id, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)))
        out = docs.join(kept, ids == F.col(name), "left_semi")
    return out.unionByName(nameless)
