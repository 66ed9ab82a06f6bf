"""Market tables derived from the supplied order, line-item and event tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.session import SHUFFLE_PARTITIONS
from factorloom.sources.tables import scan

TASK_ROWS = 1_000_000  # trades that a task turns to bars


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan(spark, f"{folder}/{name}.parquet")


def _day(column: str) -> Column:
    return F.col(column).cast("date")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Day bars: one row per supplier and ship date. ``r_volume`` is missing on most days.

    A bar has few trades, so a task holds nearly as many bars as it gets trades: above ``TASK_ROWS`` of them to each of the
    session's shuffle partitions there are more.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = _table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("order_book_id"),
        _day("l_shipdate").alias("date"),
        price.alias("p"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + price / 1e6).alias("k"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("turnover"),
        F.col("l_returnflag").alias("flag"),
    )
    tasks = math.ceil(trades.count() / TASK_ROWS)
    if tasks > int(spark.conf.get(SHUFFLE_PARTITIONS)):
        trades = trades.repartition(tasks, "order_book_id", "date")
    return trades.groupBy("order_book_id", "date").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("q").alias("volume"),
        F.round(F.sum("turnover"), 2).alias("total_turnover"),
        F.count(F.lit(1)).alias("num_trades"),
        F.sum(F.when(F.col("flag") == "R", F.col("q"))).alias("r_volume"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(
        F.col("user_id").alias("order_book_id"),
        _day("ts").alias("date"),
        F.col("ts").alias("datetime"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("open"),
    )


def minute_bars(spark: SparkSession, folder: str, hours_west: int = 0) -> DataFrame:
    """Minute bars, with the clock of a place so many hours to the west."""
    local = F.col("datetime") - F.make_dt_interval(hours=F.lit(hours_west))
    minute = F.date_trunc("minute", local).cast("timestamp_ntz")
    return (
        ticks(spark, folder)
        .groupBy("order_book_id", minute.cast("date").alias("date"), minute.alias("datetime"))
        .agg(F.min_by("open", "seq").alias("open"), F.round(F.sum("open"), 2).alias("volume"))
    )


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Day bars over the event month: few dates, many instruments."""
    return (
        ticks(spark, folder)
        .groupBy("date", "order_book_id")
        .agg(
            F.min_by("open", "seq").alias("open"),
            F.max("open").alias("high"),
            F.count(F.lit(1)).alias("num_trades"),
        )
    )


def type_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks with the event type as the instrument."""
    return _table(spark, folder, "events").select(
        F.col("event_type").alias("order_book_id"),
        _day("ts").alias("date"),
        F.col("ts").alias("datetime"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("open"),
    )


def factor_long(spark: SparkSession, folder: str) -> DataFrame:
    """Long factors with repeated keys; names A, N and R."""
    return _table(spark, folder, "lineitem").select(
        _day("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("order_book_id"),
        F.col("l_returnflag").alias("factor_name"),
        F.col("l_discount").alias("factor_value"),
    )


def event_factors(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(
        _day("ts").alias("date"),
        F.col("user_id").alias("order_book_id"),
        F.col("event_type").alias("factor_name"),
        F.col("value").alias("factor_value"),
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").select(_day("l_shipdate").alias("date")).distinct()


def event_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(_day("ts").alias("date")).distinct()


def order_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").select(_day("o_orderdate").alias("date"))


def index_member(spark: SparkSession, folder: str) -> DataFrame:
    """Index membership of each bar: the region of its supplier."""
    regions = (
        _table(spark, folder, "supplier")
        .join(_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("order_book_id"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("index_code"),
        )
    )
    keys = bars(spark, folder).select("date", "order_book_id")
    return keys.join(regions, "order_book_id").select("date", "index_code", "order_book_id")


def event_index_member(spark: SparkSession, folder: str) -> DataFrame:
    """Index membership over the event month: the region of the customer."""
    regions = (
        _table(spark, folder, "customer")
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("order_book_id"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("index_code"),
        )
    )
    keys = ticks(spark, folder).select("date", "order_book_id").distinct()
    return keys.join(regions, "order_book_id").select("date", "index_code", "order_book_id")
