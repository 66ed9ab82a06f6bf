"""Bars and factors stored alike: no exchange in a join, hot instruments spread, names in column groups."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from factorloom.operators.reshape import attach_factors, pivot_factors
from factorloom.sources.aligned import GROUP, AlignedStore

DAYS = [dt.date(2024, 1, d) for d in range(1, 11)]
LONG = "date date, order_book_id string, factor_name string, factor_value double"
BARS = "date date, order_book_id string, open double"


@pytest.fixture
def plain_joins(spark):
    """No broadcast, so that a missing layout would show as an exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def bars_of(frame, days=DAYS):
    rows = [(d, f"s{i}", float(i)) for d in days for i in range(6)]
    return frame([*rows, (None, "s1", 1.0), (days[0], None, 2.0)], BARS)


def factors_of(frame, days=DAYS, names=("a", "b", "c", "d", "e")):
    rows = [
        (d, f"s{i}", n, float(k * i + d.day)) for d in days for i in range(5) for k, n in enumerate(names) if (i + k) % 4
    ]
    odd = [(days[0], "s1", "a", float("nan")), (days[1], "s1", "a", float("inf")), (days[2], "s1", "b", 77.0),
           (None, "s1", "a", 1.0), (days[0], "s1", None, 1.0), (days[0], "s5", "e", None), (days[3], "zz", "b", 4.0)]
    return frame(rows + odd, LONG)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_equal_to_pivot_and_join(spark, frame, tmp_path, plain_joins):
    bars, factors = bars_of(frame), factors_of(frame)
    store = AlignedStore.create(bars, f"{tmp_path}/s", buckets=4, width=2)
    assert store.add_factors(factors) == ["a", "b", "c", "d", "e"]
    known = factors.dropna("any", subset=["date", "order_book_id", "factor_name"])
    wide = pivot_factors(known, ["a", "b", "c", "d", "e"])
    attached, kept = store.attach(), store.wide()
    assert rows_of(attached.select("date", "order_book_id", "open", *"abcde")) == rows_of(
        attach_factors(bars, wide).select("date", "order_book_id", "open", *"abcde"))
    assert rows_of(kept.select(*wide.columns)) == rows_of(wide)
    assert rows_of(store.wide(["e", "a"])) == rows_of(pivot_factors(known, ["e", "a"]))
    assert exchanges(attached) == exchanges(store.wide(["a", "b"])) == 0
    assert exchanges(kept) == 1  # the keys alone: names lie in three groups
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("factorloom_")]


def test_opened_again_and_grown(spark, frame, tmp_path):
    path = f"{tmp_path}/s"
    first, later = DAYS[:6], DAYS[6:]
    AlignedStore.create(bars_of(frame, first), path, buckets=3, width=2).add_factors(factors_of(frame, first), ["a", "b", "c"])
    store = AlignedStore(spark, path)
    store.add_factors(factors_of(frame, first), ["d", "e"])
    for _ in range(2):  # days that are stored are not stored twice
        store.add_days(bars_of(frame, DAYS), factors_of(frame, DAYS))
    more = bars_of(frame, first).unionByName(bars_of(frame, later).dropna())
    known = factors_of(frame, first).unionByName(factors_of(frame, DAYS).filter(F.col("date") > first[-1]))
    wide = pivot_factors(known.dropna("any", subset=["date", "order_book_id", "factor_name"]), ["a", "b", "c", "d", "e"])
    assert rows_of(store.attach().select("date", "order_book_id", "open", *"abcde")) == rows_of(
        attach_factors(more, wide).select("date", "order_book_id", "open", *"abcde"))


def test_wanted_groups_alone_are_read(frame, tmp_path):
    store = AlignedStore.create(bars_of(frame), f"{tmp_path}/s", buckets=2, width=2)
    store.add_factors(factors_of(frame))
    group = store.places()["c"][0]
    opened = {os.path.basename(os.path.dirname(f)) for f in store.attach(["c"]).inputFiles()}
    assert opened == {"bars", f"{GROUP}={group}"}
    assert store.attach([]).columns == ["date", "order_book_id", "open"]


def test_thousands_of_names(spark, tmp_path, plain_joins):
    bars = spark.range(40).select(F.lit(DAYS[0]).alias("date"), F.concat(F.lit("s"), "id").alias("order_book_id"))
    names = [f"f{i:04d}" for i in range(5000)]
    factors = bars.filter("order_book_id < 's2'").crossJoin(
        spark.range(5000).select(F.format_string("f%04d", "id").alias("factor_name"), F.col("id").cast("double").alias("factor_value")))
    store = AlignedStore.create(bars, f"{tmp_path}/s", buckets=2)
    assert store.add_factors(factors) == names
    assert len({g for g, _ in store.places().values()}) == 20
    found = store.attach(["f0000", "f2600", "f4999"])
    assert exchanges(found) == 0
    values = {tuple(r)[2:] for r in found.collect()}
    assert values == {(0.0, 2600.0, 4999.0), (None, None, None)}


def test_a_hot_instrument_fills_all_buckets(spark, tmp_path):
    days = spark.range(4000).select(F.date_add(F.lit(DAYS[0]), F.col("id").cast("int")).alias("date"))
    bars = days.select("date", F.lit("hot").alias("order_book_id"))
    AlignedStore.create(bars, f"{tmp_path}/s", buckets=8)
    counts = [spark.read.parquet(f).count() for f in glob.glob(f"{tmp_path}/s/bars/*.parquet")]
    assert len(counts) == 8 and sum(counts) == 4000 and max(counts) < 700


def test_refused_names(frame, tmp_path):
    store = AlignedStore.create(bars_of(frame), f"{tmp_path}/s", buckets=2, width=2)
    store.add_factors(factors_of(frame), ["a"])
    with pytest.raises(ValueError, match="already stored"):
        store.add_factors(factors_of(frame), ["a"])
    with pytest.raises(ValueError, match="already stored"):
        store.add_factors(factors_of(frame), ["open"])
    with pytest.raises(ValueError, match="no such factor"):
        store.attach(["nope"])


def test_empty_tables(spark, tmp_path):
    store = AlignedStore.create(spark.createDataFrame([], BARS), f"{tmp_path}/s")
    assert store.add_factors(spark.createDataFrame([], LONG)) == []
    assert store.wide().count() == 0 and store.attach().count() == 0
    assert store.add_factors(spark.createDataFrame([], LONG), ["a"]) == ["a"]
    assert store.wide(["a"]).columns == ["date", "order_book_id", "a"] and store.wide().count() == 0
    assert os.path.isdir(f"{tmp_path}/s/names")


def test_a_stopped_write_is_written_anew(spark, frame, tmp_path):
    path = f"{tmp_path}/it's"
    store = AlignedStore.create(bars_of(frame), path, buckets=2)
    with pytest.raises(ValueError, match="holds a store already"):
        AlignedStore.create(bars_of(frame), path)
    os.remove(f"{path}/layout/_SUCCESS")
    assert rows_of(AlignedStore.create(bars_of(frame), path, buckets=2).bars()) == rows_of(bars_of(frame))
    assert store.bars().count() == 62
