"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly, by a seeded hash of a record and its number
in the table, into buckets that fit in a worker's memory; their number follows the
table's bytes.  The number deals out records that are equal too, so no bucket grows
with a record's copies.  Pass 2 takes each bucket as a whole, puts it in a set order,
shuffles it with Fisher-Yates under a seed of its own, and numbers its records.
Buckets come one after another, so a record's place is its bucket's first place plus
its own; places are dealt out in turn, so shards differ by one record at most.
Partitions hold BUCKETS_EACH buckets, one after another, where the table has more
buckets than shuffle partitions; a worker holds one bucket at a time.

A bucket's order comes from the records and their numbers alone, so a task that runs
again gives the same records the same places, as long as the table is read in the
same splits; equal records can stand for each other.

Defined cases: a null text has no bytes; repeated rows are records of their own; a
null id is a value like others; an empty table gives no rows.  Columns of map type
have no part in the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, prepare, running_starts, text_of

SHARDS = 8
BUCKET_BYTES, BUCKETS_EACH = 16 << 20, 8


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: from the last place down, each swaps with one up to it."""
    out = np.arange(n)
    draws = (rng.random(n) * (np.arange(n) + 1)).astype(np.int64).tolist()
    order = out.tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    out[:] = order
    return out


def external_shuffle(docs: DataFrame, *, text: str = "text", shards: int = SHARDS, seed: int = 8, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str, str]:
    """docs in shuffled places: (docs with a shard and a slot, the shard's column name, the slot's)."""
    spark = prepare(docs.sparkSession)
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    total = docs.select(F.octet_length(text_of(docs, text)).alias("b")).agg(F.coalesce(F.sum(F.col("b") + 64), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // bucket_bytes))
    bucket, rank, number, place = (free_name(docs, n) for n in ("bucket", "rank", "number", "place"))
    tagged = docs.withColumn(rank, F.xxhash64(F.lit(seed), *hashable)).withColumn(number, F.monotonically_increasing_id())
    tagged = tagged.withColumn(bucket, F.pmod(F.xxhash64(F.lit(~seed), F.col(rank), F.col(number)), F.lit(buckets)).cast("int")).select(*docs.columns, rank, bucket, number)
    # first places: counts of a few bytes for each bucket
    counts = tagged.groupBy(bucket).agg(F.count("*").alias("n"))
    first = running_starts(counts, [], bucket, "n", place).drop("n")
    parts = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS_EACH))
    scattered = tagged.repartitionById(parts, F.col(bucket) % parts).sortWithinPartitions(bucket)
    width = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(bucket, T.IntegerType()), T.StructField(rank, T.LongType())])

    def shuffle(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held).combine_chunks()
        number = whole.column(width + 1)[0].as_py()
        keys = pa.table({"r": whole.column(width), "k": whole.column(width + 2)})
        order = compute.sort_indices(keys, sort_keys=[("r", "ascending"), ("k", "ascending")]).to_numpy()
        order = order[fisher_yates(len(order), np.random.default_rng([seed, number]))]
        for low in range(0, len(order), 2048):
            part = whole.take(pa.array(order[low : low + 2048])).combine_chunks()
            place_in = np.arange(low, low + part.num_rows)
            yield from pa.Table.from_arrays([*part.columns[:width], pa.array(np.full(part.num_rows, number), pa.int32()), pa.array(place_in, pa.int64())], names=schema.names).combine_chunks().to_batches()

    def run(batches):
        held, last = [], None
        for batch in batches:
            own = batch.column(width + 1).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if held and own[a] != last:
                    yield from shuffle(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = own[a]
        if held:
            yield from shuffle(held)

    shuffled = scattered.mapInArrow(run, schema)
    spot = F.col(place) + F.col(rank)
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    placed = shuffled.join(first, bucket)  # one row a bucket; Spark broadcasts them if they are small
    return placed.select(*docs.columns, F.pmod(spot, F.lit(shards)).cast("int").alias(shard), F.floor(spot / F.lit(shards)).cast("int").alias(slot)), shard, slot


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shuffles docs and writes them, one folder a shard; a shard's files are runs of its slots, written by tasks of their own."""
    placed, shard, slot = external_shuffle(docs, **options)
    placed.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)
