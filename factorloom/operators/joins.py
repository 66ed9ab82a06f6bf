"""Joins on keys that may be NULL, or that may be hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.session import materialize

HOT_KEYS = 1_000


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join where NULL keys match; keeps the left key columns."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = reduce(
        Column.__and__, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on]
    )
    return left.join(renamed, condition, "left").drop(*[f"__r_{c}" for c in on])


def group_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot_keys: int = HOT_KEYS, least: int = 1_000_000
) -> DataFrame:
    """``null_safe_join`` with a ``right`` that has one row per key, when few keys may hold most of ``left``.

    Keys with more than ``least`` and ``1 / hot_keys`` of the left rows (so fewer than ``hot_keys`` of them) are
    joined by broadcast, and no task sorts the rows of one.
    """
    sizes = materialize(left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    rows = sizes.agg(F.sum("__n")).first()[0] or 0
    large = sizes.filter(F.col("__n") > max(rows // hot_keys, least)).select(*on)
    if large.isEmpty():
        return null_safe_join(left, right, on)
    renamed = large.withColumnsRenamed({c: f"__h_{c}" for c in on})
    hot = lambda df: reduce(Column.__and__, [df[c].eqNullSafe(renamed[f"__h_{c}"]) for c in on])
    marks = right.join(F.broadcast(renamed), hot(right), "left_semi")
    lifted = left.join(F.broadcast(renamed), hot(left), "left_semi")
    lifted = null_safe_join(lifted, F.broadcast(marks), on)
    rest = left.join(F.broadcast(renamed), hot(left), "left_anti")
    return lifted.unionByName(null_safe_join(rest, right, on))


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    measured: DataFrame | None = None,
    hot_keys: int = HOT_KEYS,
    least: int = 1_000_000,
) -> DataFrame:
    """Inner join of ``left`` with a ``right`` that has one row per key.

    Keys with more than ``1 / hot_keys`` of the left rows (so fewer than ``hot_keys`` of them)
    are joined by broadcast; the rest by an ordinary shuffle join. ``measured`` is a cheaper
    table with the same key counts as ``left``.
    """
    on = list(on)
    measured = left if measured is None else measured
    rows = measured.count()
    limit = max(rows // hot_keys, least)
    if rows <= limit:
        return left.join(right, on)
    hot = (
        measured.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > limit)
        .drop("__n")
    )
    if hot.isEmpty():
        return left.join(right, on)
    hot = F.broadcast(hot)
    lifted = left.join(hot, on, "left_semi").join(
        F.broadcast(right.join(hot, on, "left_semi")), on
    )
    return lifted.unionByName(left.join(hot, on, "left_anti").join(right, on))
