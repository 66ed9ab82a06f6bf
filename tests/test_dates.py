"""Dates come from the data and from folder names, never from constants or from opened files."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from factorloom import catalog
from factorloom.operators import filters
from factorloom.sources import calendar, tables
from factorloom.sources import market_views as views

FOLDER = "/root/testdata/sf0.001"
S = tables.PartitionStrategy


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_later_days_lose_no_row(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    later = rows.limit(500).withColumn("l_shipdate", F.col("l_shipdate") + F.expr("INTERVAL 900 DAYS"))
    rows.unionByName(later).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    bars = views.bars(spark, str(tmp_path))
    assert catalog.returns(spark, str(tmp_path)).count() == bars.count() > views.bars(spark, FOLDER).count()
    last = bars.agg(F.max("date")).first()[0]
    assert catalog.as_of(views.calendar(spark, str(tmp_path))) == last
    checks = {r["check"]: r["value"] for r in catalog.QUERIES["validate_bars"](spark, str(tmp_path)).collect()}
    assert checks["rows"] == bars.count()


@pytest.mark.parametrize("strategy", [S.DATE, S.DATE_AND_STOCK, S.FACTOR_AND_DATE, S.NONE])
def test_folder_dates_open_no_file(spark, tmp_path, strategy):
    days = [dt.date(2024, 1, d) for d in (1, 2, 5)]
    rows = [(d, f"s{i}", f"f{i % 2}", float(i)) for i in range(4) for d in days]
    frame = spark.createDataFrame(rows, "date date, order_book_id string, factor_name string, v double")
    config = tables.TableConfig("t", strategy)
    path = f"{tmp_path}/t"
    assert calendar.folder_dates(spark, path, config).count() == 0
    tables.write_table(frame, config, path)
    if strategy is not S.NONE:  # a file that is opened would fail
        for folder, _, files in os.walk(path):
            for name in files:
                if name.endswith(".parquet"):
                    with open(os.path.join(folder, name), "wb") as file:
                        file.write(b"no parquet")
                    crc = os.path.join(folder, f".{name}.crc")
                    if os.path.exists(crc):
                        os.remove(crc)
    found = calendar.folder_dates(spark, path, config)
    assert sorted(r["date"] for r in found.collect()) == days


def test_the_last_day_alone_is_read(spark, tmp_path):
    moments = [dt.datetime(2024, 1, d, h) for d in (1, 2, 3) for h in (10, 14 if d == 3 else 16)]
    rows = [(m.date(), "s", m) for m in moments]
    config = tables.TableConfig("t")
    path = f"{tmp_path}/t"
    tables.write_table(spark.createDataFrame(rows, "date date, order_book_id string, datetime timestamp_ntz"), config, path)
    stored = tables.scan(spark, path)
    last = catalog.as_of(calendar.folder_dates(spark, path, config))
    assert last == dt.date(2024, 1, 3)
    kept = filters.drop_incomplete_day(stored, last)
    assert sorted(r["datetime"] for r in kept.collect()) == moments[:4]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-01-03" in plan
    assert filters.drop_incomplete_day(stored).count() == 4
