"""Aggregates over many columns as one grouped aggregate over (column, value) rows.

One wide aggregate over hundreds of columns outgrows generated code; rows are exploded within
the scan stage and combined on the map side, so the shuffle stays tiny whatever the width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def number(column: str) -> Column:
    """The column as a double, NaN as NULL."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def tall(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row (column position ``c``, value ``v``) per value, NULL included, beside the ``by`` columns."""
    return df.select(*by, F.posexplode(F.array(*[number(c) for c in columns])).alias("c", "v"))


def named(df: DataFrame, columns: Sequence[str], name: str = "column") -> DataFrame:
    """Replace the column position by the column's name."""
    label = F.get(F.array(*[F.lit(c) for c in columns]), F.col("c")).alias(name)
    return df.select(label, *[c for c in df.columns if c != "c"])


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Row]:
    """Rows, values, mean, sample std, min and max of each column."""
    rows = (
        tall(df, columns)
        .groupBy("c")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("v").alias("n"),
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("std"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
        )
        .collect()
    )
    return {columns[r["c"]]: r for r in rows}
