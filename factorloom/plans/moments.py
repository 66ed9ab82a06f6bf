"""Moments of pairs of columns, gathered in Arrow blocks, and the scores that follow from them.

A task adds up what it reads and emits one row per pair; Spark merges these rows with differences of means, so
nothing cancels that does not cancel in the data. Scores of every sum and difference of columns follow
from the matrix of their second moments: thousands of linear formulas cost one read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import kernels
from factorloom.functions.registry import Registry, ScalarFunction
from factorloom.plans import expressions as ex

# a and b number the values of a pair; aa, ab, bb are sums of products around the means, dd of their difference
SCHEMA = (
    "kind int, mask int, a int, b int, n bigint, bad bigint, "
    "ma double, mb double, aa double, ab double, bb double, dd double"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
INTEGERS = {"kind": pa.int32(), "mask": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64(), "bad": pa.int64()}
ALONE, MATRIX = 0, 1
CELLS = 1 << 22  # of a matrix at once
HUGE = 1e100  # values beyond leave the matrix: sums of them may be set to 0
CLOSE = 1e-3  # of squares around the first value, or of both variances; below, values are measured from their mean
CANCELS = 1e-5  # of the terms' variance; below, a linear formula is evaluated itself


class Score(NamedTuple):
    rows: int
    mse: float | None
    r2: float | None
    ic: float | None
    rank_ic: float | None = None


class Marked:
    """The rows of a block that a score counts, and the target on them."""

    def __init__(self, mask: np.ndarray, y: np.ndarray):
        self.rows = np.flatnonzero(mask)
        self.n = len(self.rows)
        self.y = y[self.rows]
        if self.n:
            gap = self.y - self.y[0]
            mean = gap.mean()
            gap -= mean
            self.mean, self.rest, self.spread = self.y[0] + mean, gap.sum(), gap @ gap
            self.weights = np.zeros((2, len(y)))
            self.weights[0, self.rows], self.weights[1, self.rows] = 1.0, gap
            self._room = np.empty(len(y))

    def sums(self, values: np.ndarray) -> tuple[float, float, float, float]:
        """The first value, and from it the sums of the values, of their products with the target's gaps and of their squares."""
        room, own, first = self._room, self.weights[0], values[self.rows[0]]
        np.subtract(values, first, out=room)
        np.multiply(room, own, out=room)
        return first, room.dot(own), room.dot(self.weights[1]), room.dot(room)


class PairSums:
    """Moments of many values with the target, one set per value; blocks are added one after the other."""

    def __init__(self, count: int):
        self.n = np.zeros(count)
        self.bad = np.zeros(count)
        self.means = np.zeros((count, 2))
        self.sums = np.zeros((count, 4))  # aa, ab, bb, dd

    def add(self, i: int, values: np.ndarray, y: np.ndarray) -> None:
        held = ~np.isnan(values)
        if not held.all():
            values, y = values[held], y[held]
        n = len(values)
        if not n:
            return
        # measured from the first value, so that a constant has no spread at all
        a, b = values - values[0], y - y[0]
        ma, mb = a.mean(), b.mean()
        a -= ma
        b -= mb
        d = b - a
        means = np.array([[values[0] + ma, y[0] + mb]])
        self._merge(np.array([i]), n, means, np.array([[a @ a, a @ b, b @ b, d @ d]]))

    def add_all(self, places: Sequence[int], found: Sequence[tuple], marked: Marked, value: Callable[[int], np.ndarray]) -> None:
        """Add the marked rows of several values by their ``sums``.

        Values that are missing or infinite somewhere, nearly constant around a far first value, or nearly the
        target are added one by one.
        """
        n, i = marked.n, np.array(places)
        first, one, ab, squares = np.array(found).T
        mean = one / n
        aa, ab = squares - one * mean, ab - mean * marked.rest
        bb = np.full(len(i), marked.spread)
        dd = aa + bb - 2 * ab
        sure = np.isfinite(first + mean + aa + ab + dd) & (aa >= CLOSE * squares) & (dd >= CLOSE * (aa + bb))
        means = np.stack([first + mean, np.full(len(i), marked.mean)], axis=1)
        self._merge(i[sure], n, means[sure], np.stack([aa, ab, bb, dd], axis=1)[sure])
        for k in i[~sure].tolist():
            self.add(k, value(k).take(marked.rows), marked.y)

    def _merge(self, i: np.ndarray, n: int, means: np.ndarray, own: np.ndarray) -> None:
        total, gap = self.n[i] + n, means - self.means[i]
        a, b = gap.T
        between = np.stack([a * a, a * b, b * b, (b - a) ** 2], axis=1)
        self.sums[i] += own + between * (self.n[i] * n / total)[:, None]
        self.means[i] += gap * (n / total)[:, None]
        self.n[i] = total

    def batch(self, mask: int) -> pa.RecordBatch:
        i = np.flatnonzero((self.n > 0) | (self.bad > 0))
        numbers = np.full(len(i), ALONE), np.full(len(i), mask), i, i, self.n[i], self.bad[i]
        return _batch([*numbers, *self.means[i].T, *self.sums[i].T])


class MatrixSums:
    """Second moments of columns (the target is column 0) around their means."""

    def __init__(self, columns: int):
        self.n, self.mean, self.sums = 0, np.zeros(columns), np.zeros((columns, columns))
        self.bad = np.zeros(columns)

    def add(self, values: np.ndarray) -> None:
        """Add a block, a row of it for each column; a column with missing or huge values is marked."""
        if not values.shape[1]:
            return
        odd = ~((values.max(axis=1) < HUGE) & (values.min(axis=1) > -HUGE))
        self.bad += odd
        values[odd] = 0.0
        n, first = values.shape[1], values[:, 0].copy()
        values -= first[:, None]
        mean = values.mean(axis=1)
        values -= mean[:, None]
        gap = first + mean - self.mean
        total = self.n + n
        self.sums += values @ values.T + np.outer(gap, gap) * (self.n * n / total)
        self.mean += gap * (n / total)
        self.n = total

    def batch(self, mask: int, pairs: Sequence[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (np.array(x, np.int64) for x in zip(*pairs))
        c, size = self.sums, np.full(len(a), self.n)
        dd = c[a, a] + c[b, b] - 2 * c[a, b]
        numbers = np.full(len(a), MATRIX), np.full(len(a), mask), a, b, size, self.bad[a] + self.bad[b]
        return _batch([*numbers, self.mean[a], self.mean[b], c[a, a], c[a, b], c[b, b], dd])


def _batch(columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(x).cast(INTEGERS.get(n, pa.float64())) for n, x in zip(NAMES, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def merged(parts: DataFrame) -> DataFrame:
    """One row per kind, mask and pair, by one exchange of a row per task and pair.

    The tasks' rows of a pair are added in an order of their own, so that the last digits do not depend on which task ends first.
    """
    key = ["kind", "mask", "a", "b"]
    held = F.array_sort(F.collect_list(F.struct("ma", "mb", "n", "bad", "aa", "ab", "bb", "dd")))
    total = lambda value, zero="0D": F.expr(f"aggregate(p, {zero}, (s, x) -> s + {value})")
    whole = parts.groupBy(*key).agg(held.alias("p")).withColumns({"n": total("x.n", "0L"), "bad": total("x.bad", "0L")})
    whole = whole.withColumns({m: F.try_divide(total(f"x.n * x.{m}"), F.col("n")) for m in ("ma", "mb")})
    gaps = {"aa": ("x.ma - ma", "x.ma - ma"), "ab": ("x.ma - ma", "x.mb - mb"), "bb": ("x.mb - mb", "x.mb - mb")}
    gaps["dd"] = ("x.mb - mb - (x.ma - ma)",) * 2
    sums = [total(f"x.{name} + x.n * ({one}) * ({two})").alias(name) for name, (one, two) in gaps.items()]
    return whole.select(*key, "n", "bad", "ma", "mb", *sums)


def score(n: float, ma: float, mb: float, aa: float, ab: float, bb: float, dd: float) -> Score:
    """The scores of values ``a`` as predictions of ``b``."""
    if not n:
        return Score(0, None, None, None)
    mse = max(dd, 0.0) / n + (mb - ma) ** 2
    known = lambda x: x if x is not None and math.isfinite(x) else None
    r2 = 1 - mse / (bb / n) if bb > 0 else None
    ic = ab / (math.sqrt(aa) * math.sqrt(bb)) if aa > 0 and bb > 0 else None
    return Score(int(n), known(mse), known(r2), known(ic))


# ---- linear formulas -------------------------------------------------------------------------

Form = tuple[float, dict[ex.Expr, float]]


def signs(functions: Registry) -> dict[str, float]:
    """The names under which the protected sum and difference are offered."""
    known = {kernels.SCALARS["safe_add"]: 1.0, kernels.SCALARS["safe_sub"]: -1.0}
    return {
        n: known[f.kernel] for n, f in functions.items() if isinstance(f, ScalarFunction) and f.kernel in known
    }


def linear_form(expr: ex.Expr, sign: Mapping[str, float]) -> Form:
    """A constant and the weight of each part that is no sum or difference itself, also where it comes to 0: a row
    where the part is missing does not follow the form."""
    if isinstance(expr, (int, float)):
        return float(expr), {}
    if not isinstance(expr, tuple) or expr[0] not in sign:
        return 0.0, {expr: 1.0}
    (c, left), (d, right) = (linear_form(a, sign) for a in expr[1:])
    s = sign[expr[0]]
    weights = dict(left)
    for part, weight in right.items():
        weights[part] = weights.get(part, 0.0) + s * weight
    return c + s * d, weights


def pairs_of(forms: Iterable[Form], number: Mapping[ex.Expr, int]) -> list[tuple[int, int]]:
    """The pairs of columns that the scores of some forms need; the target has number 0."""
    found = {(0, 0)}
    for _, weights in forms:
        places = sorted({0, *(number[p] for p in weights)})
        found.update((a, b) for i, a in enumerate(places) for b in places[i:])
    return sorted(found)


class Matrix:
    """Merged second moments of one mask."""

    def __init__(self, rows: Iterable, number: Mapping[ex.Expr, int]):
        self.number = number
        self.rows = {(r["a"], r["b"]): r for r in rows}

    def _at(self, a: int, b: int) -> float:
        return self.rows[min(a, b), max(a, b)]["ab"]

    def score(self, form: Form) -> Score | None:
        """None where the moments do not tell: a part has missing or huge values, or the parts cancel."""
        if (0, 0) not in self.rows:
            return Score(0, None, None, None)
        constant, weights = form
        terms = [(self.number[p], w) for p, w in weights.items()]
        own = [self.rows[i, i] for i, _ in terms]
        if any(r["bad"] for r in own):
            return None
        y = self.rows[0, 0]
        mean = constant + sum(w * r["ma"] for (_, w), r in zip(terms, own))
        aa = sum(w * v * self._at(i, j) for i, w in terms for j, v in terms)
        if len(terms) > 1 and aa < CANCELS * sum(w * w * r["aa"] for (_, w), r in zip(terms, own)):
            return None
        ab = sum(w * self._at(0, i) for i, w in terms)
        dd = aa + y["aa"] - 2 * ab
        if dd < CANCELS * (aa + y["aa"]):
            return None
        return score(y["n"], mean, y["ma"], aa, ab, y["aa"], dd)


def matrix_of(df: DataFrame, columns: Sequence[str], y: str, pairs: Sequence[tuple[int, int]], where: Column | None = None) -> DataFrame:
    """Merged second moments of ``columns`` on the rows that have a target, by one read of these columns."""
    target = F.col(y).cast("double")
    rows = df.filter(target.isNotNull() & ~F.isnan(target))
    if where is not None:
        rows = rows.filter(where)
    rows = rows.select(target.alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums = MatrixSums(len(columns) + 1)
        rows = max(CELLS // (len(columns) + 1), 1)
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                sums.add(np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns]))
        if sums.n:
            yield sums.batch(0, pairs)

    return merged(rows.mapInArrow(run, SCHEMA))


def score_linear(df: DataFrame, exprs: Sequence[ex.Expr], y: str, functions: Registry) -> dict[ex.Expr, Score]:
    """Scores of those ``exprs`` that are sums and differences of columns and numbers and that the moments tell."""
    sign = signs(functions)
    forms = {e: linear_form(e, sign) for e in exprs}
    forms = {e: f for e, f in forms.items() if all(isinstance(p, str) for p in f[1])}
    columns = sorted({p for _, weights in forms.values() for p in weights})
    if not columns:
        return {}
    number = {c: i + 1 for i, c in enumerate(columns)}
    found = matrix_of(df, columns, y, pairs_of(forms.values(), number)).collect()
    matrix = Matrix(found, number)
    scores = {e: matrix.score(f) for e, f in forms.items()}
    return {e: s for e, s in scores.items() if s is not None}
