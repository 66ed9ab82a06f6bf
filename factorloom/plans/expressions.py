"""Factor expressions as nested tuples, evaluated together in a few window stages.

``("safe_mul", ("ts_mean_5", "open"), 2.0)`` is a function over columns, numbers and other
expressions. All expressions of a batch share one layout by instrument; equal parts are computed
once, one stage per level of window nesting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.registry import Registry
from factorloom.functions.windows import WindowFunction, apply_windows
from factorloom.operators.series import KEYS, ORDER, Series, lay_out

Expr = str | float | int | tuple


def text(expr: Expr) -> str:
    if isinstance(expr, tuple):
        return f"{expr[0]}({', '.join(text(a) for a in expr[1:])})"
    return expr if isinstance(expr, str) else f"{float(expr):g}"


def size(expr: Expr) -> int:
    """Number of functions, columns and constants."""
    return 1 + sum(size(a) for a in expr[1:]) if isinstance(expr, tuple) else 1


def depth(expr: Expr) -> int:
    return 1 + max(depth(a) for a in expr[1:]) if isinstance(expr, tuple) else 0


def columns(expr: Expr) -> set[str]:
    if isinstance(expr, tuple):
        return set().union(*(columns(a) for a in expr[1:]))
    return {expr} if isinstance(expr, str) else set()


def check(expr: Expr, functions: Registry) -> None:
    if not isinstance(expr, tuple):
        return
    name, *args = expr
    if name not in functions:
        raise ValueError(f"unknown function {name!r}")
    if functions[name].arity != len(args):
        raise ValueError(f"{name} takes {functions[name].arity} arguments, got {len(args)}")
    for arg in args:
        check(arg, functions)


def _windowed(expr: Expr, functions: Registry) -> bool:
    return isinstance(expr, tuple) and isinstance(functions[expr[0]], WindowFunction)


def lookback(expr: Expr, functions: Registry) -> int:
    """Earlier rows of the instrument that can influence a value."""
    if not isinstance(expr, tuple):
        return 0
    own = functions[expr[0]].size - 1 if _windowed(expr, functions) else 0
    return own + max(lookback(a, functions) for a in expr[1:])


def _level(expr: Expr, functions: Registry) -> int:
    """How many window functions are nested in each other."""
    if not isinstance(expr, tuple):
        return 0
    below = max(_level(a, functions) for a in expr[1:])
    return below + 1 if _windowed(expr, functions) else below


def _nodes(expr: Expr) -> set[tuple]:
    return {expr}.union(*(_nodes(a) for a in expr[1:])) if isinstance(expr, tuple) else set()


def _column(expr: Expr, staged: Mapping[Expr, str]) -> Column:
    if isinstance(expr, str):
        return F.col(expr).cast("double")
    return F.col(staged[expr]) if isinstance(expr, tuple) else F.lit(float(expr))


def evaluate_on(series: Series, exprs: Mapping[str, Expr], functions: Registry) -> Series:
    """Add one column per expression to rows that are already laid out.

    Every distinct part becomes a column of its own, so the plan grows with the number of parts
    and never with the nesting. Windows of one nesting level share one pass.
    """
    for expr in exprs.values():
        check(expr, functions)
    nodes = sorted(set().union(*(_nodes(e) for e in exprs.values())), key=lambda n: (depth(n), text(n)))
    staged: dict[Expr, str] = {n: f"__x{i}" for i, n in enumerate(nodes)}
    keep = series.rows.columns
    for level in range(1 + max((_level(n, functions) for n in nodes), default=0)):
        here = [n for n in nodes if _level(n, functions) == level]
        windows = [n for n in here if _windowed(n, functions)]
        fixed = {n: f"__c{i}" for i, n in enumerate(windows) if isinstance(n[1], (int, float))}
        if fixed:
            constants = {name: F.lit(float(n[1])) for n, name in fixed.items()}
            series = series.with_rows(series.rows.withColumns(constants))
        if windows:
            calls = {
                staged[n]: (functions[n[0]], fixed.get(n) or staged.get(n[1], n[1]))
                for n in windows
            }
            series = apply_windows(series, calls)
        scalars = [n for n in here if n not in windows]
        for height in sorted({depth(n) for n in scalars}):
            added = {
                staged[n]: functions[n[0]].build(*[_column(a, staged) for a in n[1:]])
                for n in scalars
                if depth(n) == height
            }
            series = series.with_rows(series.rows.withColumns(added))
    values = [_column(e, staged).alias(name) for name, e in exprs.items()]
    return series.with_rows(series.rows.select(*keep, *values))


def evaluate(
    df: DataFrame,
    exprs: Mapping[str, Expr],
    functions: Registry,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block_rows: int | None = None,
) -> DataFrame:
    """Factor values per row: ``df`` plus one column per expression."""
    reach = max((lookback(e, functions) for e in exprs.values()), default=0)
    if reach:
        series = lay_out(df, keys, order, before=reach, block_rows=block_rows)
    else:
        series = Series(df, tuple(keys), tuple(order))
    return evaluate_on(series, exprs, functions).own()
