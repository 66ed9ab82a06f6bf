"""Functions offered to factor expressions, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from factorloom.functions import kernels, scalars, timeseries
from factorloom.functions.windows import WindowFunction


@dataclass(frozen=True)
class ScalarFunction:
    """``build(*columns)`` gives a column from the same row, best from built-in functions.

    ``kernel(*arrays)`` is the same over numpy arrays with NaN for missing; with it, searches
    score formulas in blocks.
    """

    name: str
    arity: int
    build: Callable[..., Column]
    kernel: Callable[..., np.ndarray] | None = None


Function = ScalarFunction | WindowFunction
Registry = dict[str, Function]

# Function names offered to users.
MATH = {
    "safe_add": (2, scalars.safe_add),
    "safe_sub": (2, scalars.safe_sub),
    "safe_mul": (2, scalars.safe_mul),
    "safe_div": (2, scalars.safe_div),
    "safe_log": (1, scalars.safe_log),
    "safe_sqrt": (1, scalars.safe_sqrt),
    "safe_abs": (1, scalars.safe_abs),
}
STANDARD = ("add", "sub", "mul", "div", "log", "sqrt", "abs")


def registry(functions: Iterable[Function]) -> Registry:
    return {f.name: f for f in functions}


def math_functions() -> list[Function]:
    return [ScalarFunction(n, arity, build, kernels.SCALARS[n]) for n, (arity, build) in MATH.items()]


def standard_functions() -> list[Function]:
    """The short names, with the same protected meaning."""
    return [ScalarFunction(n, *MATH[f"safe_{n}"], kernels.SCALARS[f"safe_{n}"]) for n in STANDARD]


def rolling_functions(sizes: Sequence[int]) -> list[Function]:
    return [timeseries.rolling_function(fn, size) for size in sizes for fn in timeseries.ROLLING]


def default_registry(
    window_sizes: Sequence[int] = timeseries.WINDOW_SIZES, use_custom_functions: bool = True
) -> Registry:
    """Rolling and protected math functions, or the short-named standard set."""
    if not use_custom_functions:
        return registry(standard_functions())
    return registry([*rolling_functions(window_sizes), *math_functions()])


def custom_function_set() -> Registry:
    """The seven rolling functions over 10 rows."""
    return registry(rolling_functions((10,)))
