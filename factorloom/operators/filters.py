"""Row filters used while cleaning bars."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from factorloom.functions.scalars import finite

# Hour of the close, and the reach of the outlier filter.
CLOSE_HOUR = 15
SIGMAS = 10.0


def _floating(df: DataFrame) -> dict[str, DataType]:
    return {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}


def inf_to_null(df: DataFrame) -> DataFrame:
    """Infinities and NaN become NULL in every floating-point column."""
    return df.withColumns({c: finite(F.col(c)).cast(t) for c, t in _floating(df).items()})


def present(column: str, df: DataFrame) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) if column in _floating(df) else c.isNotNull()


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(present(target, df))


def drop_any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows complete in all ``columns`` (NaN counts as missing)."""
    return df.dropna("any", subset=list(columns))


def sigma_outlier_filter(df: DataFrame, target: str, sigmas: float = SIGMAS) -> DataFrame:
    """Keep |target| <= sigmas * std, measured from zero; off when the std is 0 or undefined."""
    reach = F.nullif(sigmas * F.stddev_samp(target), F.lit(0.0))
    limit = df.agg(F.coalesce(reach, F.lit(float("inf")))).scalar()
    return df.filter(F.abs(F.col(target)) <= limit)


def drop_incomplete_day(df: DataFrame, last: dt.date | None = None) -> DataFrame:
    """Drop the latest date when its last row is before 15:00.

    With ``last``, the latest date as folder names tell it, only the rows of that date are read to decide.
    """
    latest = F.max(F.struct("date", "datetime"))
    cut = F.when(F.hour(latest["datetime"]) < CLOSE_HOUR, latest["date"])
    seen = df if last is None else df.filter(F.col("date") == F.lit(last))
    dropped = seen.agg(cut).scalar()
    return df.filter(F.coalesce(F.col("date") < dropped, F.lit(True)))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty; check the date range and the source")
    return df
