"""Minute and tick tables are mined end to end, in their own order."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest

from factorloom.plans.miner import FactorMiner
from factorloom.plans.mining import PREDICTION, MiningConfig, mine_source
from factorloom.plans.search import SearchSettings
from factorloom.sources.tables import (
    BAR_ORDERS, SOURCES, PartitionStrategy, TableConfig, bar_order, scan_bars, stock_path, write_table,
)

SMALL = SearchSettings(population_size=30, generations=2, beam=5, max_depth=2)
SCHEMA = "date date, order_book_id string, datetime timestamp_ntz, seq long, open double, volume double"
START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 4)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    chance = np.random.default_rng(5)
    folder = str(tmp_path_factory.mktemp("db"))
    for source, step in (("minute", 60), ("tick", 20)):
        rows = []
        for name in ("s1", "s2", "s3"):
            for i in range(150):
                # three ticks share a moment; the sequence number runs against the order of writing
                seconds = i * 60 if source == "minute" else i // 3 * step
                moment = dt.datetime(2024, 1, 1 + i // 40, 9) + dt.timedelta(seconds=seconds)
                rows.append((moment.date(), name, moment, i, 10 + chance.random(), chance.random()))
        frame = spark.createDataFrame(rows[::-1], SCHEMA)
        frame = frame.drop("seq") if source == "minute" else frame
        write_table(frame, TableConfig(SOURCES[source], PartitionStrategy.DATE), stock_path(folder, SOURCES[source]))
    return folder


@pytest.mark.parametrize("source", ["minute", "tick"])
def test_mined_in_the_order_of_the_source(spark, root, tmp_path, source):
    config = MiningConfig(data_source=source, window_sizes=(3,), search=SMALL)
    order = list(BAR_ORDERS[source])
    model = mine_source(spark, root, START, END, config, f"{tmp_path}/out", features=["open", "volume"])
    saved = spark.read.parquet(f"{tmp_path}/out/factor_values.parquet")
    assert set(saved.columns) == {"date", "order_book_id", *order, "factor_value"}
    assert saved.count() == saved.select("order_book_id", *order).distinct().count() == 3 * 130
    chosen = replace(model, result=replace(model.result, best=("ts_mean_3", "open")))
    found = chosen.values().select("order_book_id", *order, "open", PREDICTION).toPandas().sort_values(["order_book_id", *order])
    means = found.groupby("order_book_id")["open"].transform(lambda v: v.rolling(3, min_periods=1).mean())
    np.testing.assert_allclose(found[PREDICTION], means, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("source", ["minute", "tick"])
def test_the_miner_object_does_the_same(spark, root, source):
    config = MiningConfig(data_source=source, window_sizes=(3,), search=SMALL)
    miner = FactorMiner.from_source(spark, root, config).load(START, END).prepare(features=["open", "volume"]).train()
    whole = mine_source(spark, root, START, END, config, features=["open", "volume"])
    assert miner.expression == whole.expression
    assert miner.model.result.history == whole.result.history


def test_an_unordered_table_is_refused(spark, root):
    with pytest.raises(ValueError, match="unique order"):
        bar_order(scan_bars(spark, root, "minute"), "tick")
