"""Trading calendar arithmetic: which dates exist, are missing, or are new."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.tables import TableConfig, as_date, between_dates, read_if_present, stock_path

DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # folder of rows without a date

# Fixed value: first date of the market's history.
GLOBAL_START = dt.date(1990, 12, 19)


def load_calendar(spark: SparkSession, root: str) -> DataFrame:
    path = stock_path(root, "trading_calendar.parquet")
    found = read_if_present(spark, path)
    if found is None:
        raise FileNotFoundError(f"no trading calendar at {path}")
    return found


def trading_dates(calendar: DataFrame, start: str | dt.date, end: str | dt.date) -> DataFrame:
    return between_dates(calendar.select("date"), start, end).distinct().orderBy("date")


def existing_dates(table: DataFrame) -> DataFrame:
    """Dates that hold data, whatever folder level the date is on."""
    return table.select(F.col("date").cast("date").alias("date")).dropna().distinct()


def folder_dates(spark: SparkSession, path: str, config: TableConfig) -> DataFrame:
    """Dates of a stored table from the names of its folders, on whatever level they are; no data file is opened.

    The writer makes a folder only for rows it has, and a table that is not stored has no dates. A table without folders
    by date is read.
    """
    levels = config.partition_columns
    if "date" not in levels:
        table = read_if_present(spark, path, config.schema)
        return spark.createDataFrame([], "date date") if table is None else existing_dates(table)
    pattern = "/".join([path.rstrip("/"), *[f"{c}=*" for c in levels[: levels.index("date") + 1]]])
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    names = {f.getPath().getName().split("=", 1)[1] for f in found if f.isDirectory()}
    days = [(dt.date.fromisoformat(n),) for n in names if n != DEFAULT_PARTITION]
    return spark.createDataFrame(sorted(days), "date date")


def missing_dates(
    calendar: DataFrame,
    existing: DataFrame,
    as_of: str | dt.date,
    use_global_start: bool = False,
) -> DataFrame:
    """Trading dates without data, from the first stored date up to ``as_of``."""
    first = F.lit(GLOBAL_START)
    if not use_global_start:
        first = F.coalesce(existing.agg(F.min("date")).scalar(), first)
    due = calendar.filter((F.col("date") >= first) & (F.col("date") <= F.lit(as_date(as_of))))
    return due.select("date").distinct().join(existing, "date", "left_anti").orderBy("date")


def new_dates(calendar: DataFrame, existing: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Trading dates after the last stored date, up to ``as_of``."""
    last = existing.agg(F.max("date")).scalar()
    due = F.coalesce(F.col("date") > last, F.col("date") >= F.lit(GLOBAL_START))
    return (
        calendar.filter(due & (F.col("date") <= F.lit(as_date(as_of))))
        .select("date")
        .distinct()
        .orderBy("date")
    )
