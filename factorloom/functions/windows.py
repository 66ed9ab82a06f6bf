"""Functions over the latest rows of an instrument, and how a batch of them is computed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.kernels import Segments
from factorloom.functions.scalars import finite
from factorloom.operators.series import Series

Parts = dict[str, Column]
LONG_WINDOW = 64  # rows; beyond, a frame read anew for every row costs more than an Arrow group


@dataclass(frozen=True)
class WindowFunction:
    """A value from up to ``size`` rows of one instrument.

    ``parts(x, series)`` gives the window aggregates and ``finish(x, parts)`` the value. Parts
    of the same name, input and size are computed once for all functions of a batch.
    ``zero_guard`` asks for 0 on instruments whose input is zero throughout. ``kernel(x, segments, zero)``
    is the same over arrays, if there is one: searches use it, and so do windows above ``LONG_WINDOW`` rows.
    """

    name: str
    size: int
    parts: Callable[[Column, Series], Parts]
    finish: Callable[[Column, Parts], Column]
    zero_guard: bool = False
    arity: int = 1
    kernel: Callable[[np.ndarray, Segments, np.ndarray | None], np.ndarray] | None = None

    @property
    def long(self) -> bool:
        return self.kernel is not None and self.size > LONG_WINDOW


def window_function(
    name: str, size: int, build: Callable[[Column, Series], Column]
) -> WindowFunction:
    """A function given by a single window expression."""
    return WindowFunction(
        name, size, lambda x, series: {name: build(x, series)}, lambda x, parts: parts[name]
    )


def all_zero(x: Column) -> Column:
    return F.coalesce(x == 0, F.lit(False))


def apply_windows(
    series: Series, calls: Mapping[str, tuple[WindowFunction, str]]
) -> Series:
    """Add one column per call (function, input column): one window pass, then a projection.

    Long windows that have a kernel follow, instrument by instrument, in groups of the same layout.
    """
    long = {out: call for out, call in calls.items() if call[0].long}
    short = {out: call for out, call in calls.items() if out not in long}
    series = _by_frames(series, short) if short else series
    return _by_kernels(series, long) if long else series


def _by_kernels(series: Series, calls: Mapping[str, tuple[WindowFunction, str]]) -> Series:
    """The same in constant or logarithmic work a row: each group is sorted and its arrays are read whole."""
    guarded = sorted({c for f, c in calls.values() if f.zero_guard})
    marks = {c: f"__zero_{i}" for i, c in enumerate(guarded)}
    if series.split:  # a block does not see its whole instrument
        series, flags = series.every_row({marks[c]: all_zero(F.col(c).cast("double")) for c in guarded})
        rows = series.rows.withColumns(flags)
    else:
        rows, marks = series.rows, {}
    keep = [c for c in rows.columns if c not in marks.values()]
    order = [(c, "ascending") for c in series.order]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        segments = Segments(np.array([len(table)]))
        out = table.select(keep)
        for name, (function, c) in calls.items():
            x = pc.fill_null(table[c].cast(pa.float64()), np.nan).to_numpy()
            zero = table[marks[c]].slice(0, 1).to_numpy() if c in marks else None
            values = function.kernel(x, segments, zero)
            out = out.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        return out

    fields = [rows.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in calls]
    return series.with_rows(rows.groupBy(*series.partition).applyInArrow(run, T.StructType(fields)))


def _by_frames(series: Series, calls: Mapping[str, tuple[WindowFunction, str]]) -> Series:
    value = {c: F.col(c).cast("double") for _, c in calls.values()}
    guarded = sorted({c for f, c in calls.values() if f.zero_guard})
    zero = {c: f"__zero_{i}" for i, c in enumerate(guarded)}
    series, windows = series.every_row({zero[c]: all_zero(value[c]) for c in guarded})
    names: dict[tuple[str, int, str], str] = {}
    held: dict[str, dict[str, str]] = {}
    for out, (function, c) in calls.items():
        held[out] = {}
        for part, column in function.parts(finite(value[c]), series).items():
            key = (c, function.size, part)
            if key not in names:
                names[key] = f"__part_{len(names)}"
                windows[names[key]] = column
            held[out][part] = names[key]
    keep = [c for c in series.rows.columns if c not in zero.values()]
    rows = series.rows.withColumns(windows)
    finished = []
    for out, (function, c) in calls.items():
        parts = {part: F.col(name) for part, name in held[out].items()}
        result = function.finish(finite(value[c]), parts)
        if function.zero_guard:
            result = F.when(F.col(zero[c]), 0.0).otherwise(result)
        finished.append(result.alias(out))
    return series.with_rows(rows.select(*keep, *finished))
