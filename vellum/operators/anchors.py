"""Groups that start at anchors: a position joins the last anchor less than ``reach`` before it, any other is an anchor itself.

Each position's successor is the first one ``reach`` or more after it; anchors are the
chain of successors from a key's first position.  Keys are cut into blocks of BLOCK
times ``reach``, so a key with very many positions spreads:

1. In a block, successors are doubled (the successor's successor, and so on), which gives
   for each position the last anchor and the number of anchors, if it were one.  As an anchor
   before the block reaches ``reach`` into it at most, few positions may be the block's first.
2. A pass over the blocks of a key, in order, takes from each what the one of these
   that follows the last anchor gives.  It carries that anchor and a count.
3. In a block, the chain from the first anchor, now known, gives all starts; rows of the
   block find theirs by halving.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import written

REACH, BLOCK = 8.0, 1024


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def successors(places: np.ndarray, bounds: np.ndarray, reach: float) -> np.ndarray:
    """For each place of the sorted rows bounds[i]:bounds[i+1] the first one of its row that is ``reach`` or more after it; len(places) if none is."""
    out = np.full(len(places), len(places))
    for a, b in zip(bounds, bounds[1:]):
        own = places[a:b]
        at = np.searchsorted(own, own + reach)
        # a sum may be rounded, a difference is what counts
        at = np.where((at > 0) & (own[np.maximum(at - 1, 0)] - own >= reach), at - 1, at)
        at = np.where((at < b - a) & (own[np.minimum(at, b - a - 1)] - own < reach), at + 1, at)
        out[a:b] = np.where(at < b - a, a + at, len(places))
    return out


def doubled(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last, count): where the chain from each place ends, and how many places it has."""
    n = len(following)
    step, last, count = np.append(following, n), np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
    while (step[:n] < n).any():
        last, count, step = np.where(step < n, last[step], last), count + count[step], step[step]
    return last[:n], count[:n]


def _summaries(batch: pa.RecordBatch, reach: float) -> pa.RecordBatch:
    """(key, block, places that may come first, the last anchor and the number of anchors after each)."""
    lists = batch.column(2)
    bounds, places = _offsets(lists), lists.flatten().to_numpy()
    last, count = doubled(successors(places, bounds, reach))
    # those within reach of the block's first place, and the one after them
    rows = [np.arange(a, min(a + int(np.searchsorted(places[a:b] - places[a], reach)) + 1, b)) for a, b in zip(bounds, bounds[1:])]
    cuts = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    own = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (places[at], places[last[at]], count[at])]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["key", "block", "places", "last", "count"])


def _carry(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """(key, block, entry, before): the first anchor of each block, by its number among the block's places, and the number of anchors before it."""
    key, anchor, before = object(), None, 0
    for batch in batches:
        entries, counts = [], []
        bounds = _offsets(batch.column(2))
        places, last, count = (batch.column(i).flatten().to_numpy() for i in (2, 3, 4))
        for own, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
            if own != key:
                key, anchor, before = own, None, 0
            entry = 0 if anchor is None else int(np.argmax(np.append(places[a:b] - anchor >= reach, True)))
            entries.append(entry)
            counts.append(before)
            if a + entry < b:
                anchor, before = last[a + entry], before + int(count[a + entry])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int32()), pa.array(counts, pa.int64())], names=["key", "block", "entry", "before"])


def _chains(batch: pa.RecordBatch, reach: float) -> pa.RecordBatch:
    """(key, block, before, starts) of (key, block, before, entry, places); all rows of a batch take their steps at once."""
    lists = batch.column(4)
    bounds, places = _offsets(lists), lists.flatten().to_numpy()
    step = np.append(successors(places, bounds, reach), len(places))
    at, on = bounds[:-1] + batch.column(3).to_numpy(), np.zeros(len(places) + 1, bool)
    at = at[at < bounds[1:]]
    while len(at):
        on[at] = True
        at = step[at]
        at = at[at < len(places)]
    upto = np.concatenate([[0], np.cumsum(on[:-1])])[bounds]
    starts = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(places[on[:-1]]))
    return pa.RecordBatch.from_arrays([*batch.columns[:3], starts], names=["key", "block", "before", "starts"])


def _places(rows: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """(key, block, places): the distinct places of each key, or of each block of it."""
    block = F.col(by[0]) if by else F.lit(0).cast("long")
    grouped = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), *[F.col(b).alias("block") for b in by])
    return grouped.agg(F.array_sort(F.collect_set(F.col(value).cast("double"))).alias("places")).select("key", F.col("block") if by else block.alias("block"), "places")


def _schema(places: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*places.schema.fields[:2], *[T.StructField(n, t) for n, t in fields]])


def _starts(entered: DataFrame, reach: float) -> DataFrame:
    """(key, block, before, starts) of (key, block, before, entry, places)."""
    schema = _schema(entered, ("before", T.LongType()), ("starts", T.ArrayType(T.DoubleType())))
    return entered.select("key", "block", "before", "entry", "places").mapInArrow(lambda batches: (_chains(b, reach) for b in batches), schema)


def anchor_starts(places: DataFrame, reach: float = REACH) -> DataFrame:
    """(_key, _block, before, starts) of places (key, block, places): the anchors of each block, and how many its key has before them."""
    places, doubles = written(places), T.ArrayType(T.DoubleType())
    short = places.mapInArrow(lambda batches: (_summaries(b, reach) for b in batches), _schema(places, ("places", doubles), ("last", doubles), ("count", T.ArrayType(T.LongType()))))
    ordered = short.repartition("key").sortWithinPartitions("key", "block")
    carried = ordered.mapInArrow(lambda batches: _carry(batches, reach), _schema(places, ("entry", T.IntegerType()), ("before", T.LongType())))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))
    return _starts(places.withColumnsRenamed({"key": "_key", "block": "_block"}).join(carried, same), reach)


def anchored(rows: DataFrame, key: str, value: str, reach: float = REACH, together: bool = False) -> DataFrame:
    """rows with the number of their group in their key, ``line_idx``, from 0; -1 for rows without a value.

    together: a key's rows stand in one task as they are, as the words of a document do that
    were unfolded from its row; then a key is one block, and no more is shuffled.
    """
    v = F.col(value).cast("double")
    powers = F.transform(F.sequence(F.floor(F.log2(F.greatest(F.size("starts"), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    packed = F.struct(powers.alias("powers"), "before", "starts")
    if together:
        one = lambda some, name: _starts(_places(some, key, value).select("key", "block", F.lit(0).cast("long").alias("before"), F.lit(0).alias("entry"), "places"), reach).select(F.col("key").alias("_key"), packed.alias(name))
        # a join by null-safe equality would deal all rows out anew; rows without a key are one group, which is brought to them
        named = rows.join(one(rows.where(F.col(key).isNotNull()), "_own"), F.col(key) == F.col("_key"), "left").drop("_key")
        nameless = F.broadcast(one(rows.where(F.col(key).isNull()), "_nameless").drop("_key"))
        found = named.join(nameless, F.col(key).isNull(), "left").withColumn("_of", F.coalesce("_own", "_nameless"))
    else:
        blocked = rows.withColumn("_in", F.coalesce(F.floor(v / (reach * BLOCK)), F.lit(0)))
        starts = anchor_starts(_places(blocked, key, value, "_in"), reach)
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_in") == F.col("_block"))
        found = blocked.join(starts.select("_key", "_block", packed.alias("_of")), same, "left")
    here = F.aggregate("_of.powers", F.lit(0), lambda n, p: n + F.when(F.get("_of.starts", n + p - 1) <= v, p).otherwise(0))
    number = F.when(v.isNull(), -1).otherwise(F.coalesce(F.col("_of.before") + here, F.lit(0)) - 1)
    return found.withColumn("line_idx", number.cast("int")).select(*rows.columns, "line_idx")
