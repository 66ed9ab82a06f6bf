"""Long factor tables to wide, and wide factors beside bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalars import finite

FACTOR_KEYS = ("date", "order_book_id")


def pivot_factors(
    factors: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = FACTOR_KEYS
) -> DataFrame:
    """One row per key and one column per factor, the mean of duplicates.

    Duplicates are averaged before the pivot's own shuffle, so a key repeated many times is
    reduced on the map side. Keys whose values are all missing give no row.
    """
    valued = factors.withColumn("factor_value", finite(F.col("factor_value").cast("double")))
    valued = valued.filter(F.col("factor_value").isNotNull())
    groups = valued.groupBy(*keys)
    wide = groups.pivot("factor_name", list(names) if names is not None else None)
    table = wide.agg(F.avg("factor_value"))
    return table.dropna("all", subset=[c for c in table.columns if c not in keys])


def attach_factors(
    bars: DataFrame, wide: DataFrame, keys: Sequence[str] = FACTOR_KEYS
) -> DataFrame:
    """Factor columns beside bars by key. The join side is left to the optimizer, which
    broadcasts by measured size and splits skewed keys of the bar side."""
    return bars.join(wide, list(keys), "left")
