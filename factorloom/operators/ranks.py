"""Cumulative counts over globally ordered values, without a one-task window.

Values are first reduced to (value, count), written once in range order with their partition
number, and numbered from per-partition totals. A value that holds a third of all rows is one
row here, and the ranges are even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.joins import null_safe_join
from factorloom.session import materialize

_PART = "__part"


def running_counts(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Add ``before`` (rows with a smaller value in the group) and ``total`` (rows in the group).

    ``counts`` has one row per group and value.
    """
    by = list(by)
    stored = materialize(
        counts.repartitionByRange(*by, value).withColumn(_PART, F.spark_partition_id()), "ranges"
    )
    parts = stored.groupBy(*by, _PART).agg(F.sum(n).alias("__held"))
    group = Window.partitionBy(*by, F.lit(0)).orderBy(_PART)
    offsets = parts.select(
        *by,
        _PART,
        F.coalesce(
            F.sum("__held").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
        F.sum("__held")
        .over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("total"),
    )
    inside = (
        Window.partitionBy(*by, _PART)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = null_safe_join(stored, offsets, by + [_PART])
    return joined.withColumn(
        "before", F.col("__offset") + F.sum(n).over(inside) - F.col(n)
    ).drop(_PART, "__offset")


def average_ranks(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Add ``rank``: ties share the mean of the positions they occupy, starting at 1."""
    counted = running_counts(counts, by, value, n)
    return counted.withColumn("rank", F.col("before") + (F.col(n) + 1) / 2)


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles per group, one row per group and probability (``p``, ``value``).

    Works from the ordered counts, so one group may hold most of the rows.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*by, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_counts(counts, by, "__v")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    position = (F.col("total") - 1) * F.col("p")
    low, high = F.floor(position), F.ceil(position)
    inside = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    return (
        placed.withColumn("p", wanted)
        .filter(inside(low) | inside(high))
        .select(
            *by,
            "p",
            (position - low).alias("share"),
            F.when(inside(low), F.col("__v")).alias("a"),
            F.when(inside(high), F.col("__v")).alias("b"),
        )
        .groupBy(*by, "p")
        .agg(
            (F.max("a") + (F.max("b") - F.max("a")) * F.max("share")).alias("value")
        )
    )
