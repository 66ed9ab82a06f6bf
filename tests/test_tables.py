"""Stored tables, the calendar and refresh jobs."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import StructType

from factorloom.operators import filters, schema
from factorloom.operators.reshape import attach_factors, pivot_factors
from factorloom.operators.series import forward_return
from factorloom.sources import calendar as cal
from factorloom.sources import tables as tb
from factorloom.streaming.refresh import RefreshJob

DAY = dt.date(2024, 1, 1)
BARS = "date date, order_book_id string, open double"


def day(n):
    return DAY + dt.timedelta(days=n)


def bar_rows(days, ids=("000001", "000002")):
    return [(day(d), i, float(d) + len(i)) for d in days for i in ids]


def config(strategy=tb.PartitionStrategy.DATE, ddl=BARS):
    return tb.TableConfig("day_bar", strategy, StructType.fromDDL(ddl))


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("strategy", list(tb.PartitionStrategy))
def test_write_and_read_back(frame, spark, tmp_path, strategy):
    ddl = "factor_name string, index_code string, " + BARS
    data = frame(
        [("f1", "R1", *r) for r in bar_rows(range(3))] + [("f2", "R2", *r) for r in bar_rows([9])], ddl
    )
    path = str(tmp_path / "t")
    tb.write_table(data, config(strategy, ddl), path)
    assert rows(tb.scan(spark, path, data.schema)) == rows(data)
    level = path
    for column in tb.PARTITION_COLUMNS[strategy]:
        inner = [d for d in os.listdir(level) if "=" in d]
        assert inner and all(d.startswith(f"{column}=") for d in inner)
        level = os.path.join(level, inner[0])


def test_only_touched_partitions_are_replaced(frame, spark, tmp_path):
    path = str(tmp_path / "t")
    tb.write_table(frame(bar_rows(range(3)), BARS), config(), path)
    tb.write_table(frame([(day(1), "000009", 7.0)], BARS), config(), path)
    stored = tb.scan(spark, path, config().schema)
    assert stored.count() == 5
    assert stored.filter(f"date = '{day(1)}'").first()["order_book_id"] == "000009"


@pytest.mark.parametrize("strategy", [tb.PartitionStrategy.NONE, tb.PartitionStrategy.DATE])
def test_empty_write_keeps_the_table(frame, spark, tmp_path, strategy):
    path = str(tmp_path / "t")
    tb.write_table(frame(bar_rows([0]), BARS), config(strategy), path)
    tb.write_table(frame([], BARS), config(strategy), path)
    assert tb.scan(spark, path, config().schema).count() == 2


def test_write_is_rebalanced(frame):
    hinted = frame(bar_rows([0]), BARS).hint("rebalance", "date")
    assert "RebalancePartitions" in hinted._jdf.queryExecution().optimizedPlan().toString()


def test_date_filters_prune_partitions(frame, spark, tmp_path):
    path = str(tmp_path / "t")
    tb.write_table(frame(bar_rows(range(10)), BARS), config(), path)
    found = tb.between_dates(tb.scan(spark, path, config().schema), "2024-01-02", day(3), pad_days=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert found.select("date").distinct().count() == 5
    priced = forward_return(found, horizon=1).select("order_book_id", "target_feature")
    assert "close" not in priced._jdf.queryExecution().executedPlan().toString()


def test_sources(frame, spark, tmp_path):
    root = str(tmp_path)
    for folder in ("day_bar", "minute_bar", "tick"):
        tb.write_table(frame(bar_rows([0]), BARS), config(), tb.stock_path(root, folder))
    for name in ("day", "minute", "tick"):
        assert tb.scan_bars(spark, root, name).count() == 2
    with pytest.raises(ValueError, match="unknown bar source"):
        tb.scan_bars(spark, root, "hour")


def calendar_of(frame, days):
    return frame([(day(d),) for d in days], "date date")


def dates(df):
    return [r["date"] for r in df.collect()]


def test_calendar(frame):
    trading = calendar_of(frame, [0, 1, 2, 4, 5, 8])
    stored = calendar_of(frame, [1, 4])
    assert dates(cal.trading_dates(trading, day(1), "2024-01-06")) == [day(1), day(2), day(4), day(5)]
    assert dates(cal.missing_dates(trading, stored, day(5))) == [day(2), day(5)]
    assert dates(cal.missing_dates(trading, stored, day(5), use_global_start=True)) == [
        day(0),
        day(2),
        day(5),
    ]
    assert dates(cal.new_dates(trading, stored, day(8))) == [day(5), day(8)]
    nothing = calendar_of(frame, [])
    assert len(dates(cal.missing_dates(trading, nothing, day(8)))) == 6
    assert len(dates(cal.new_dates(trading, nothing, day(8)))) == 6


def test_missing_calendar(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cal.load_calendar(spark, str(tmp_path))


def test_stored_calendar(frame, spark, tmp_path):
    path = tb.stock_path(str(tmp_path), "trading_calendar.parquet")
    none = tb.TableConfig("trading_calendar", tb.PartitionStrategy.NONE)
    tb.write_table(calendar_of(frame, [0, 3]), none, path)
    assert cal.load_calendar(spark, str(tmp_path)).count() == 2


def test_dates_below_another_level(frame, spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "factor_name string, " + BARS
    data = frame([("f", *r) for r in bar_rows([2, 5])], ddl)
    tb.write_table(data, config(tb.PartitionStrategy.FACTOR_AND_DATE, ddl), path)
    found = cal.existing_dates(tb.scan(spark, path)).orderBy("date")
    assert dates(found) == [day(2), day(5)]


@pytest.fixture
def job(frame, spark, tmp_path):
    source = frame(bar_rows([0, 1, 2, 4, 5, 8]), "date date, order_book_id string, open double")
    calls = []

    def fetch(start, end):
        calls.append((start, end))
        return tb.between_dates(source, start, end).withColumnRenamed("open", "open")

    made = RefreshJob(
        spark, config(), str(tmp_path / "bars"), calendar_of(frame, [0, 1, 2, 4, 5, 8]), fetch
    )
    return made, calls, source


def test_refresh(job):
    made, calls, source = job
    with pytest.raises(FileNotFoundError):
        made.missing(day(8))
    assert made.latest(day(1)) == (cal.GLOBAL_START, day(1))
    assert calls == [(cal.GLOBAL_START, day(1))]
    assert made.latest(day(1)) is None and len(calls) == 1
    assert made.latest(day(4)) == (day(2), day(4))
    assert made.stored().count() == 8
    tb.write_table(made.fetch_range(day(8), day(8)), made.config, made.path)
    assert made.missing(day(8)) == [day(5)]
    assert rows(made.stored()) == rows(source)
    assert made.missing(day(8)) == []
    made.full(day(8))
    assert rows(made.stored()) == rows(source)


def test_refresh_of_an_empty_folder_is_full(job):
    made, calls, _ = job
    os.makedirs(made.path)
    made.latest(day(2))
    assert calls == [(cal.GLOBAL_START, day(2))]


def test_schema_steps(frame):
    wanted = StructType.fromDDL("date date, order_book_id string, volume bigint")
    df = frame([("x", "3", 7, "2024-01-02"), ("y", "4", 6, "2024-01-01")],
               "extra string, volume string, order_book_id int, date string", 1)
    formatted = schema.format_table(df, wanted)
    assert formatted.columns == ["date", "order_book_id", "volume", "extra"]
    assert formatted.first().asDict() == {
        "date": day(0), "order_book_id": "6", "volume": 4, "extra": "y"
    }
    assert schema.format_table(df, None).columns == df.columns
    assert schema.value_fields(wanted) == ["volume"] and schema.value_fields(None) == []
    bad = frame([("n/a",)], "volume string")
    with pytest.raises(PySparkException):
        schema.cast_schema(bad, wanted).collect()
    assert schema.cast_schema(bad, wanted, strict=False).first()["volume"] is None


def test_empty_format(frame):
    assert schema.format_table(frame([], BARS), config().schema).count() == 0
    with pytest.raises(ValueError, match="is empty"):
        filters.require_rows(frame([], BARS), "the table")


def test_describe_table(frame):
    got = schema.describe_table(frame(bar_rows(range(4)), BARS)).collect()
    assert [r["value"] for r in got if r["section"] == "rows"] == ["8"]
    assert [r["name"] for r in got if r["section"] == "column"] == ["date", "order_book_id", "open"]
    assert len([r for r in got if r["section"] == "head"]) == 5


def test_factors(frame):
    long = frame(
        [
            (day(0), "a", "f", 1.0),
            (day(0), "a", "f", 3.0),
            (day(0), "a", "g", None),
            (day(1), "a", "g", float("nan")),
            (day(1), "b", "g", 5.0),
        ],
        "date date, order_book_id string, factor_name string, factor_value double",
    )
    wide = pivot_factors(long)
    assert rows(wide.select("date", "order_book_id", "f", "g")) == [
        (day(0), 2.0, None, "a"),
        (day(1), None, 5.0, "b"),
    ]
    bars = frame([(day(1), "b", 1.0), (day(2), "b", 1.0), (day(0), "a", 1.0)], BARS)
    joined = attach_factors(bars, wide)
    assert joined.columns == ["date", "order_book_id", "open", "f", "g"]
    assert joined.count() == 3 and joined.filter("g = 5 and order_book_id = 'b'").count() == 1
