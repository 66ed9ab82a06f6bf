"""Rolling functions against a pandas rendering of their contract, split and unsplit."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.functions import timeseries as ts
from factorloom.operators import series as se

DDL = "order_book_id int, date date, x double"
DAY = dt.date(2020, 1, 1)


def make(values_by_id):
    return [
        (i, DAY + dt.timedelta(days=d), v)
        for i, values in values_by_id.items()
        for d, v in enumerate(values)
    ]


def random_values(n, seed=0, missing=0.25):
    rng = np.random.default_rng(seed)
    return [None if rng.random() < missing else float(v) for v in rng.integers(-9, 9, n)]


def expected(values, fn, size):
    x = np.array([np.nan if v is None else v for v in values], float)
    if np.isnan(x).all() or (x == 0).all():
        return np.zeros(len(x))
    out = []
    for i in range(len(x)):
        w = x[max(0, i - size + 1) : i + 1]
        held = w[~np.isnan(w)]
        if fn == "rank":
            alone = len(w) < 2 or np.isnan(w[-1])
            out.append(0.0 if alone else ((held <= w[-1]).sum() - 1) / (len(w) - 1))
        elif len(held) == 0:
            out.append(0.0)
        else:
            call = {"max": np.max, "min": np.min, "mean": np.mean, "median": np.median,
                    "std": np.std, "sum": np.sum}[fn]
            out.append(float(call(held)))
    return np.array(out)


def collect(df, *columns):
    rows = df.orderBy("order_book_id", "date").collect()
    return {c: np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in columns}


SERIES = {
    1: random_values(400),
    2: [None] * 12,
    3: [0.0] * 12,
    4: [0.0, None] * 6,
    5: [7.0],
    6: random_values(40, 1, 0.0),
}


@pytest.mark.parametrize("block_rows", [10**9, 100, 7, 1])
def test_contract(frame, block_rows):
    df = frame(make(SERIES), DDL)
    got = ts.add_rolling(df, "x", sizes=(3, 10), block_rows=block_rows)
    names = [f"ts_{fn}_{n}" for n in (3, 10) for fn in ts.ROLLING]
    assert got.columns == ["order_book_id", "date", "x", *names]
    values = collect(got, *names)
    for n in (3, 10):
        for fn in ts.ROLLING:
            want = np.concatenate([expected(v, fn, n) for v in SERIES.values()])
            np.testing.assert_allclose(values[f"ts_{fn}_{n}"], want, atol=1e-9, err_msg=f"{fn} {n}")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float)), min_size=1, max_size=30),
    st.integers(1, 12),
    st.integers(1, 8),
)
def test_properties(spark, values, size, block_rows):
    df = spark.createDataFrame(make({1: values}), DDL)
    got = collect(
        ts.add_rolling(df, "x", ["rank", "min", "median", "max"], (size,), block_rows=block_rows),
        *[f"ts_{f}_{size}" for f in ("rank", "min", "median", "max")],
    )
    rank, low, middle, high = got.values()
    assert ((rank >= 0) & (rank <= 1)).all()
    assert (low <= middle).all() and (middle <= high).all()
    np.testing.assert_allclose(middle, expected(values, "median", size))


def test_shuffled_input_gives_the_same(frame):
    rows = make({1: random_values(60)})
    one = collect(ts.add_rolling(frame(rows, DDL), "x"), "ts_rank_10", "ts_sum_10")
    two = collect(ts.add_rolling(frame(rows[::-1], DDL, 5), "x"), "ts_rank_10", "ts_sum_10")
    for c in one:
        np.testing.assert_array_equal(one[c], two[c])


def test_one_exchange_and_no_python(frame):
    rolled = ts.add_rolling(frame(make({1: [1.0] * 5}), DDL), "x", sizes=(3, 5, 10, 20))
    plan = rolled._jdf.queryExecution().sparkPlan().toString()
    executed = rolled._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert executed.count("Exchange hashpartitioning(order_book_id") == 1
    assert executed.count("Sort [order_book_id") == 1


@pytest.mark.parametrize("block_rows", [10**9, 5])
def test_momentum(frame, block_rows):
    values = [2.0, 3.0, None, 4.0, 5.0, 8.0, 0.0, 1.0, 2.0]
    got = ts.add_momentum(frame(make({1: values}), DDL), "x", [3], block_rows=block_rows)
    want = [math.nan] * 5 + [1.0, -1.0, -0.875, math.nan]
    np.testing.assert_allclose(collect(got, "ts_momentum_3")["ts_momentum_3"], want)


@pytest.mark.parametrize("block_rows", [10**9, 50, 3])
def test_forward_return(frame, block_rows):
    values = [float(v) for v in range(1, 201)]
    values[0] = 0.0
    got = se.forward_return(frame(make({1: values, 2: values[:25]}), DDL), "x", block_rows=block_rows)
    got = collect(got, "target_feature")["target_feature"]
    want = []
    for v in (values, values[:25]):
        for i, p in enumerate(v):
            known = i + 20 < len(v) and p != 0
            want.append((v[i + 20] - p) / p if known else math.nan)
    np.testing.assert_allclose(got, want)


def test_forward_return_infinite(frame):
    df = frame(make({1: [0.0, 0.0, 5.0, -2.0]}), DDL)
    got = se.forward_return(df, "x", horizon=1, infinite=True)
    np.testing.assert_allclose(
        collect(got, "target_feature")["target_feature"], [math.nan, math.inf, -1.4, math.nan]
    )


@pytest.mark.parametrize("block_rows", [10**9, 6, 1])
def test_fill_gaps(frame, block_rows):
    data = {1: random_values(50, 3, 0.8), 2: [None] * 9, 3: [None, None, 4.0, None]}
    got = se.fill_gaps(frame(make(data), DDL), ["x"], block_rows=block_rows)
    want = np.concatenate(
        [pd.Series(v, dtype=float).ffill().bfill().fillna(0.0) for v in data.values()]
    )
    assert got.columns == ["order_book_id", "date", "x"]
    np.testing.assert_allclose(collect(got, "x")["x"], want)


def test_hot_instrument_is_cut_into_even_blocks(frame):
    """One instrument with most rows is spread over many window groups."""
    df = frame(make({1: [1.0] * 2000, **{i: [1.0] * 10 for i in range(2, 50)}}), DDL)
    laid = se.lay_out(df, before=9, block_rows=100)
    sizes = [r["count"] for r in laid.rows.groupBy(*laid.partition).count().collect()]
    assert laid.split and max(sizes) <= 100 + 9 + 1
    assert laid.own().count() == df.count()


def test_null_instrument_and_timestamps(frame):
    start = dt.datetime(2024, 1, 1)
    rows = [(None, start + dt.timedelta(seconds=20 * i), float(i)) for i in range(300)]
    rows += [(1, start + dt.timedelta(seconds=20 * i), float(i)) for i in range(5)]
    df = frame(rows, "order_book_id int, datetime timestamp_ntz, x double")
    got = {
        b: ts.add_rolling(df, "x", ["sum"], (4,), order=["datetime"], block_rows=b)
        .orderBy("order_book_id", "datetime")
        .collect()
        for b in (10**9, 10)
    }
    assert got[10**9] == got[10]


@pytest.mark.parametrize("call", ["back", "ahead"])
def test_crowded_minute_is_cut_too(frame, call):
    """All rows of the hot instrument lie in one second; ties are told apart by ``seq``."""
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(1, at + dt.timedelta(microseconds=i // 3), i % 3, float(i % 11)) for i in range(900)]
    rows += [(2, at, i, float(i)) for i in range(5)]
    df = frame(rows, "order_book_id int, datetime timestamp_ntz, seq int, x double")
    order = ["datetime", "seq"]

    def run(block_rows):
        if call == "back":
            out = ts.add_rolling(df, "x", ["sum", "rank"], (7,), order=order, block_rows=block_rows)
        else:
            out = se.forward_return(df, "x", 5, order=order, block_rows=block_rows)
        return out.orderBy("order_book_id", *order).collect()

    assert run(10**9) == run(50)
    laid = se.lay_out(df, order=order, before=6, block_rows=50)
    assert max(r["count"] for r in laid.rows.groupBy(*laid.partition).count().collect()) <= 56


def test_number_slices(frame):
    df = frame([(1, i, float(i % 7)) for i in range(5000)], "order_book_id int, seq bigint, x double")
    plain, cut = (
        ts.add_rolling(df, "x", ["mean"], (20,), order=["seq"], block_rows=b).orderBy("seq").collect()
        for b in (10**9, 1500)
    )
    assert plain == cut


def test_stored_layout_needs_no_exchange(frame):
    df = frame(make({1: random_values(300), 2: random_values(30, 5)}), DDL)
    stored = se.lay_out(df, before=9, block_rows=100).store(4)
    rolled = stored.with_rows(stored.rows.withColumn("m", F.max("x").over(stored.trailing(10))))
    assert "Exchange" not in rolled.rows._jdf.queryExecution().executedPlan().toString()
    assert rolled.own().count() == 330
