"""Overlap joins by cells: each side goes to the cells that it touches, pairs meet in these and count in the first that they share."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Axis(NamedTuple):
    """Closed intervals of both sides along one axis, and how long a cell is."""

    left_low: Column
    left_high: Column
    right_low: Column
    right_high: Column
    cell: float


#: Intervals of right in one key that are tried on each row of left of it.
FEW = 32


def _proper(frame: DataFrame, ends: list[tuple[Column, Column]], tag: str) -> DataFrame:
    for i, (low, high) in enumerate(ends):
        frame = frame.withColumns({f"_{tag}{i}": low, f"_{tag}h{i}": high}).where(F.col(f"_{tag}{i}") <= F.col(f"_{tag}h{i}"))
    return frame


def _beside(left: DataFrame, right: DataFrame, keys: list[str], axes: list[Axis]) -> DataFrame:
    """overlap_join for few rows of right a key: they are gathered and brought to the rows of left, which stay where they are."""
    more = [c for c in right.columns if c not in keys]
    ends = [f"_{tag}{i}" for i in range(len(axes)) for tag in ("r", "rh")]
    own = _proper(right, [a[2:4] for a in axes], "r").groupBy(*keys).agg(F.collect_list(F.struct(*more, *ends)).alias("_there"))

    def meets(r):
        out = F.lit(True)
        for i in range(len(axes)):
            out = out & (F.col(f"_l{i}") <= r[f"_rh{i}"]) & (r[f"_r{i}"] <= F.col(f"_lh{i}"))
        return out

    pairs = _proper(left, [a[:2] for a in axes], "l").join(own, keys).withColumn("_one", F.explode(F.filter("_there", meets)))
    return pairs.select(*left.columns, *[F.col(f"_one.{c}").alias(c) for c in more])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], axes: list[Axis], together: bool = False) -> DataFrame:
    """Pairs of one key whose intervals [low, high] meet on every axis: the columns of left, and those of right but the keys.

    A pair costs as many rows as the cells that both touch; sides that are far apart in a
    key never meet.  Intervals without ends, or that end before they begin, meet nothing.
    together: a key's rows of left stand in one task as they are; then rows of right come to them
    where a key has FEW at most, and only what belongs to other keys goes to cells.
    """
    if together:
        counts = right.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).drop("_n")
        if not counts.limit(1).count():
            return _beside(left, right, keys, axes)
        few = _beside(left, right.join(counts, keys, "left_anti"), keys, axes)
        return few.union(overlap_join(left.join(counts, keys, "left_semi"), right.join(counts, keys, "left_semi").select(*right.columns), keys, axes))
    sides = []
    for frame, ends, tag in ((left, [a[:2] for a in axes], "l"), (right, [a[2:4] for a in axes], "r")):
        for i, (axis, (low, high)) in enumerate(zip(axes, ends)):
            frame = frame.withColumns({f"_{tag}{i}": low, f"_{tag}h{i}": high}).where(F.col(f"_{tag}{i}") <= F.col(f"_{tag}h{i}"))
            cell = lambda c, size=axis.cell: F.floor(F.col(c) / F.lit(float(size))).cast("long")
            frame = frame.withColumn(f"_{tag}c{i}", F.explode(F.sequence(cell(f"_{tag}{i}"), cell(f"_{tag}h{i}"))))
        sides.append(frame)
    a, b = sides
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    for i in range(len(axes)):
        same = same & (F.col(f"_lc{i}") == F.col(f"_rc{i}"))
    pairs = a.join(b, same)
    for i, axis in enumerate(axes):
        first = F.floor(F.greatest(F.col(f"_l{i}"), F.col(f"_r{i}")) / F.lit(float(axis.cell)))
        pairs = pairs.where((F.col(f"_l{i}") <= F.col(f"_rh{i}")) & (F.col(f"_r{i}") <= F.col(f"_lh{i}")) & (F.col(f"_lc{i}") == first))
    return pairs.select(*left.columns, *[c for c in right.columns if c not in keys])
