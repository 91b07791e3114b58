"""Sums and neighbours along a key in two levels, so that no task orders all that a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def running_sum(rows: DataFrame, by: list[str], part: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """rows with ``out``, the sum of ``value`` over those before them in their ``by``.

    part: a number that never falls along ``order``.  Sums of parts run over parts, those of rows within a part.
    """
    valued = rows.withColumn("_part", part).withColumn("_value", value)
    totals = valued.groupBy(*by, "_part").agg(F.sum("_value").alias("_total"))
    upto = F.coalesce(F.sum("_total").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0))
    totals = totals.select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col("_part").alias("_of_part"), upto.alias("_upto"))
    within = F.coalesce(F.sum("_value").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(*_BEFORE)), F.lit(0))
    joined = valued.withColumn("_within", within).join(totals, _same([*by, "_part"], [*[f"_of_{b}" for b in by], "_of_part"]))
    return joined.select(*rows.columns, (F.col("_upto") + F.col("_within")).alias(out))


def neighbours(points: DataFrame, queries: DataFrame, key: str, at: str, width: float = 1024.0) -> DataFrame:
    """queries with ``before`` and ``after``: the point of their key (a struct of its columns) at or before their place, and the first one after it; null where there is none.

    points: one row for each key and place ``at``.  Both kinds are sorted together within blocks
    of ``width``; what lies in other blocks comes from these blocks' last and first points.
    """
    point = F.struct(*[F.col(c) for c in points.columns])
    query = F.struct(*[F.col(c) for c in queries.columns])
    none = lambda struct, frame: F.lit(None).cast(frame.select(struct.alias("s")).schema["s"].dataType)
    place = F.col(at).cast("double").alias("_at")
    both = points.select(F.col(key).alias("_key"), place, F.lit(0).alias("_kind"), point.alias("_point"), none(query, queries).alias("_query"))
    both = both.union(queries.select(F.col(key).alias("_key"), place, F.lit(1).alias("_kind"), none(point, points).alias("_point"), query.alias("_query")))
    both = both.withColumn("_block", F.floor(F.col("_at") / width))
    # in each block, and for each block what lies before and after it
    edges = both.groupBy("_key", "_block").agg(F.max_by("_point", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"), F.min_by("_point", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_first"))
    blocks = Window.partitionBy("_key").orderBy("_block")
    edges = edges.select(
        F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.last("_last", ignorenulls=True).over(blocks.rowsBetween(*_BEFORE)).alias("_earlier"), F.first("_first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_later")
    )
    inside = Window.partitionBy("_key", "_block").orderBy("_at", "_kind")
    near = both.withColumn("_own", F.last("_point", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_next", F.first("_point", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing))).where(F.col("_kind") == 1)
    joined = near.join(edges, _same(["_key", "_block"], ["_k", "_b"]))
    return joined.select("_query.*", F.coalesce("_own", "_earlier").alias("before"), F.coalesce("_next", "_later").alias("after"))
