"""Stored tables: layout, scans and partitioned writes."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.operators.schema import SORT_COLUMNS

log = logging.getLogger(__name__)

MISSING_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")

# Table folders of the three bar sources.
SOURCES = {"day": "day_bar", "minute": "minute_bar", "tick": "tick"}


class PartitionStrategy(Enum):
    NONE = "none"
    DATE = "date"
    DATE_AND_STOCK = "date_and_stock"
    DATE_AND_INDEX = "date_and_index"
    FACTOR_AND_DATE = "factor_and_date"


# Folder levels of each strategy, outermost first.
PARTITION_COLUMNS = {
    PartitionStrategy.NONE: (),
    PartitionStrategy.DATE: ("date",),
    PartitionStrategy.DATE_AND_STOCK: ("date", "order_book_id"),
    PartitionStrategy.DATE_AND_INDEX: ("date", "index_code"),
    PartitionStrategy.FACTOR_AND_DATE: ("factor_name", "date"),
}


@dataclass(frozen=True)
class TableConfig:
    name: str
    partition_strategy: PartitionStrategy = PartitionStrategy.DATE
    schema: StructType | None = None

    @property
    def partition_columns(self) -> tuple[str, ...]:
        return PARTITION_COLUMNS[self.partition_strategy]


@dataclass(frozen=True)
class MarketDataConfig(TableConfig):
    frequency: str = "1d"
    adjust_type: str = "none"


def stock_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/stock/{name}"


def factor_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/factor/{name}"


def scan(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A parquet table; folder columns are read as columns. A given schema avoids guessing
    folder types (an instrument code such as 000001 would turn into a number)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def scan_bars(
    spark: SparkSession, root: str, source: str = "day", schema: StructType | None = None
) -> DataFrame:
    if source not in SOURCES:
        raise ValueError(f"unknown bar source {source!r}; use one of {sorted(SOURCES)}")
    return scan(spark, stock_path(root, SOURCES[source]), schema)


# Columns that order the rows of an instrument; ticks share moments, so their sequence number decides.
BAR_ORDERS = {"day": ("date",), "minute": ("datetime",), "tick": ("datetime", "seq")}


def bar_order(bars: DataFrame, source: str, tie_break: str | None = None) -> tuple[str, ...]:
    """The order of a source's rows within an instrument; fails when the bars cannot have it."""
    if source not in BAR_ORDERS:
        raise ValueError(f"unknown bar source {source!r}; use one of {sorted(BAR_ORDERS)}")
    order = BAR_ORDERS[source]
    if tie_break:
        order = (order[0], tie_break)
    missing = [c for c in order if c not in bars.columns]
    if missing:
        raise ValueError(f"{source} bars need the columns {', '.join(missing)} for a unique order")
    return order


def require_unique_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fail when two rows of an instrument have the same place in the order."""
    again = df.groupBy(*keys, *order).count().filter(F.col("count") > 1)
    if not again.isEmpty():
        raise ValueError(f"rows are not unique by {', '.join([*keys, *order])}; name a tie-break column")
    return df


def scan_factors(
    spark: SparkSession, root: str, name: str, schema: StructType | None = None
) -> DataFrame:
    return scan(spark, factor_path(root, name), schema)


def read_if_present(
    spark: SparkSession, path: str, schema: StructType | None = None
) -> DataFrame | None:
    """The table, or None when nothing has been written there."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in MISSING_TABLE:
            return None
        raise
    return scan(spark, path, schema) if schema is not None else found


def as_date(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def in_dates(start: str | dt.date, end: str | dt.date, pad_days: int = 0) -> Column:
    last = as_date(end) + dt.timedelta(days=pad_days)
    return F.col("date").between(F.lit(as_date(start)), F.lit(last))


def between_dates(
    df: DataFrame, start: str | dt.date, end: str | dt.date, pad_days: int = 0
) -> DataFrame:
    """Rows with start <= date <= end (+ ``pad_days`` calendar days of look-ahead)."""
    return df.filter(in_dates(start, end, pad_days))


def write_table(df: DataFrame, config: TableConfig, path: str) -> None:
    """Write by the table's strategy, replacing only the partitions present in ``df``.

    The rebalance hint groups rows by partition folder and lets a large folder be written by
    several tasks. Empty input leaves the stored table as it is.
    """
    folders = config.partition_columns
    if not folders:
        if df.isEmpty():
            log.warning("%s: no rows, nothing written", config.name)
        else:
            df.write.mode("overwrite").parquet(path)
        return
    inner = [c for c in SORT_COLUMNS if c in df.columns and c not in folders]
    (
        df.hint("rebalance", *[F.col(c) for c in folders])
        .sortWithinPartitions(*folders, *inner)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


def write_factor_values(
    df: DataFrame, path: str, value: str, keys: Sequence[str] = ("date", "order_book_id")
) -> None:
    df.select(*keys, F.col(value).alias("factor_value")).write.mode("overwrite").parquet(path)
