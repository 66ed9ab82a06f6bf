"""Functions over arrays against frames of Spark and plain loops; windows of any size in flat time."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.functions import kernels
from factorloom.functions import registry as reg
from factorloom.functions import timeseries as ts
from factorloom.functions import windows
from factorloom.plans import expressions as ex

FNS = ["rank", "max", "min", "mean", "median", "std", "sum"]


def plain(fn, x, i, size):
    """A window's value by the definition."""
    window = x[max(i - size + 1, 0) : i + 1]
    held = [v for v in window if not math.isnan(v)]
    if fn == "rank":
        if all(v == 0 for v in x) or math.isnan(x[i]) or len(window) == 1:
            return 0.0
        return (sum(v <= x[i] for v in held) - 1) / (len(window) - 1)
    if not held:
        return 0.0
    return {"max": max, "min": min, "mean": np.mean, "median": np.median, "std": np.std, "sum": sum}[fn](held)


VALUES = st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6), st.just(math.nan))


@pytest.mark.parametrize("short", [0, 32])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(VALUES, max_size=30), min_size=1, max_size=3), st.integers(1, 12))
def test_windows_by_definition(short, series, size):
    segments = kernels.Segments([len(s) for s in series])
    x = np.array([v for s in series for v in s], float)
    for fn in FNS:
        if short:
            got = kernels.rolling(fn, x, segments, size)
        else:  # the way of long windows, with small ones
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(kernels, "SHORT", 0)
                got = kernels.rolling(fn, x, segments, size)
        want = [plain(fn, s, i, size) for s in series for i in range(len(s))]
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-6 if fn in ("std", "sum", "mean") else 0, err_msg=fn)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 10, 15, 16, 21, 32])
def test_shifted_windows_equal_the_matrix(monkeypatch, size):
    """To the last digit, for long and short series, ties, zeros and any stretch; missing values take the matrix."""
    rng = np.random.default_rng(size)
    for stretch in (kernels.SHIFTED, 50):
        monkeypatch.setattr(kernels, "SHIFTED", stretch)
        segments = kernels.Segments([200, 0, 1, 2, 40, 17, 0])
        for x in (rng.normal(size=260) * 10.0 ** rng.integers(-4, 4, size=260), rng.integers(-2, 3, size=260) / 3, np.zeros(260)):
            for fn in FNS:
                want = segments.windows(kernels.SHORT_WINDOWS[fn], x, size)
                np.testing.assert_array_equal(kernels.shifted(fn, x, segments, size), want, err_msg=fn)
                gaps = np.where(rng.random(260) < 0.1, np.nan, x)
                assert np.isfinite(kernels.rolling(fn, gaps, segments, size)).all()


def test_short_windows_are_read_without_a_matrix(monkeypatch):
    x, segments = np.random.default_rng(3).normal(size=5000), kernels.Segments([4000, 1000])
    made = []
    once = kernels.Segments.windows
    monkeypatch.setattr(kernels.Segments, "windows", lambda self, call, x, size, rows=None: made.append(len(x) if rows is None else len(rows)) or once(self, call, x, size, rows))
    for fn in FNS:
        kernels.rolling(fn, x, segments, 15)
    assert made == [28]  # the median of the first rows of both series


@pytest.mark.parametrize("size", [50, 333])
def test_moments_of_large_values(size):
    """Noise on 1e12 keeps nine digits of its spread, and a jump does not disturb what lies before it."""
    rng = np.random.default_rng(4)
    x = 1e12 + rng.normal(size=4000)
    x[2000:] += 1e15
    segments = kernels.Segments([len(x)])
    # differences from the last value are exact away from the jump
    near = [x[max(0, i - size + 1) : i + 1] - x[i] for i in range(len(x))]
    std = kernels.rolling("std", x, segments, size)
    np.testing.assert_allclose(std, [np.std(w) for w in near], rtol=1e-9, atol=1e-12)
    mean = kernels.rolling("mean", x, segments, size)
    np.testing.assert_allclose(mean, x + [np.mean(w) for w in near], rtol=1e-12)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for book, n in ((1, 400), (2, 150), (3, 1), (4, 90)):
        for i in range(n):
            a = 0.0 if book == 4 else round(float(rng.normal()), 1)
            b = None if rng.random() < 0.2 else float(rng.integers(-4, 5))
            rows.append((book, i, a, b if i % 31 else math.inf))
    return spark.createDataFrame(rows, "order_book_id int, date int, a double, b double").repartition(3)


@pytest.mark.parametrize("block_rows", [None, 60])
def test_long_windows_equal_frames(table, monkeypatch, block_rows):
    functions = reg.registry(
        [*reg.rolling_functions((70, 100)), ts.momentum_function(80)]
    )
    exprs = {f"{n}_{c}": (n, c) for n in functions for c in "ab"}
    exprs["deep"] = ("ts_mean_70", ("ts_rank_100", "b"))
    found = ex.evaluate(table, exprs, functions, block_rows=block_rows)
    monkeypatch.setattr(windows, "LONG_WINDOW", 10_000)
    wanted = ex.evaluate(table, exprs, functions)
    got, want = (d.orderBy("order_book_id", "date").toPandas() for d in (found, wanted))
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in exprs:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_long_windows_share_one_exchange(table):
    functions = reg.default_registry((3, 1000))
    exprs = {f"{fn}_{s}": (f"ts_{fn}_{s}", "a") for fn in FNS for s in (3, 1000)}
    plan = ex.evaluate(table, exprs, functions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scalars_equal_columns(spark):
    odd = [0.0, -0.0, 1.0, -2.5, 1e-300, 1e308, -1e308, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(a, b) for a in odd for b in odd], "a double, b double")
    for f in reg.math_functions():
        got = rows.select("a", "b", f.build(*[F.col(c) for c in "ab"[: f.arity]]).alias("v")).collect()
        a, b, v = (np.array([r[i] for r in got]) for i in range(3))
        with np.errstate(all="ignore"):
            np.testing.assert_allclose(f.kernel(*[a, b][: f.arity]), v, rtol=1e-15, err_msg=f.name)


def test_time_is_flat_in_the_window():
    """A thousand rows of window cost about what a hundred do, on a million rows."""
    x = np.random.default_rng(1).normal(size=1_000_000)
    segments = kernels.Segments([len(x)])
    for fn in FNS:
        took = {}
        for size in (100, 1000):
            begun = time.perf_counter()
            kernels.rolling(fn, x, segments, size)
            took[size] = time.perf_counter() - begun
        assert took[1000] < 3 * took[100] + 0.5 and took[1000] < 20, (fn, took)
