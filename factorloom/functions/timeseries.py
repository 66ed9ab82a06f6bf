"""Rolling functions over the last ``size`` rows of an instrument.

Windows are shorter at the start, missing values are skipped, and a window without any value
gives 0. An instrument whose input is entirely zero (or entirely missing) gives 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import kernels
from factorloom.functions.windows import Parts, WindowFunction, apply_windows
from factorloom.operators.series import KEYS, ORDER, Series, lay_out

WINDOW_SIZES = (3, 5, 10, 20)

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "values": F.collect_list,
    "rows": lambda x: F.count(F.lit(1)),
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    "std": F.stddev_pop,
    "sum": F.sum,
}


def _rank(x: Column, parts: Parts) -> Column:
    held = F.size(F.filter(parts["values"], lambda v: v <= x)) - 1
    others = parts["rows"] - 1
    return F.when(x.isNotNull() & (others > 0), held / others)


def _median(x: Column, parts: Parts) -> Column:
    values = F.sort_array(parts["values"])
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return (low + high) / 2


# function -> (window aggregates it needs, how they make the value)
ROLLING: dict[str, tuple[tuple[str, ...], Callable[[Column, Parts], Column]]] = {
    "rank": (("values", "rows"), _rank),
    "max": (("max",), lambda x, parts: parts["max"]),
    "min": (("min",), lambda x, parts: parts["min"]),
    "mean": (("mean",), lambda x, parts: parts["mean"]),
    "median": (("values",), _median),
    "std": (("std",), lambda x, parts: parts["std"]),
    "sum": (("sum",), lambda x, parts: parts["sum"]),
}


def rolling_function(fn: str, size: int) -> WindowFunction:
    """``ts_<fn>_<size>``"""
    needs, make = ROLLING[fn]

    def parts(x: Column, series: Series) -> Parts:
        return {n: AGGREGATES[n](x).over(series.trailing(size)) for n in needs}

    def finish(x: Column, held: Parts) -> Column:
        return F.coalesce(make(x, held), F.lit(0.0))

    def kernel(x: np.ndarray, segments: kernels.Segments, zero: np.ndarray | None = None) -> np.ndarray:
        return kernels.rolling(fn, x, segments, size, zero)

    return WindowFunction(f"ts_{fn}_{size}", size, parts, finish, zero_guard=fn == "rank", kernel=kernel)


def momentum_function(size: int) -> WindowFunction:
    """Change over a full window; NULL when the window is short or has a missing value."""

    def parts(x: Column, series: Series) -> Parts:
        return {
            "first": F.lag(x, size - 1).over(series.ordered()),
            "count": F.count(x).over(series.trailing(size)),
        }

    def finish(x: Column, held: Parts) -> Column:
        change = F.try_divide(x - held["first"], held["first"])
        return F.when(held["count"] == size, change)

    def kernel(x: np.ndarray, segments: kernels.Segments, zero: np.ndarray | None = None) -> np.ndarray:
        return kernels.momentum(x, segments, size)

    return WindowFunction(f"ts_momentum_{size}", size, parts, finish, kernel=kernel)


def add_windows(
    df: DataFrame,
    column: str,
    functions: Sequence[WindowFunction],
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block_rows: int | None = None,
) -> DataFrame:
    """Append one column per function; all of them share one exchange and one sort."""
    reach = max(f.size for f in functions) - 1
    series = lay_out(df, keys, order, before=reach, block_rows=block_rows)
    return apply_windows(series, {f.name: (f, column) for f in functions}).own()


def add_rolling(
    df: DataFrame,
    column: str,
    functions: Sequence[str] = tuple(ROLLING),
    sizes: Sequence[int] = (10,),
    **layout,
) -> DataFrame:
    chosen = [rolling_function(fn, size) for size in sizes for fn in functions]
    return add_windows(df, column, chosen, **layout)


def add_momentum(df: DataFrame, column: str, sizes: Sequence[int] = (10,), **layout) -> DataFrame:
    return add_windows(df, column, [momentum_function(size) for size in sizes], **layout)
