"""A value store for searches: series packed in blocks, columns and kept formulas side by side.

A pack is one row: whole series one after the other, or a piece of a long one, every column as the bytes of its values.
Packs are written once, in small row groups, so a scoring pass has no exchange and no sort; it reads packs, evaluates each distinct
formula once per pack with the array functions, and emits moments. Formulas that later ones build on are kept as columns of the
store under the formula itself, so a candidate is a few steps over stored columns however deep it is, and the plan of a pass
never grows.

A pass scores any number of (mask, formulas) sets, so several searches share one read. Formulas that have the same values by
construction are scored once, also when a later round writes them in other words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.kernels import Segments
from factorloom.functions.registry import Registry
from factorloom.functions.windows import WindowFunction
from factorloom.operators.series import Series
from factorloom.plans import expressions as ex
from factorloom.plans import moments
from factorloom.plans.canonical import Canonical
from factorloom.session import arrow_batches_of, materialize

PACK_ROWS = 16_384
TASK_ROWS = 2_000_000
PIECE_ROWS = 32_768
# parts of formulas evaluated a second time in a round before the store keeps formulas: to evaluate a part again costs a pass
# no more than to read it, and what is kept makes packs larger and is written to disk
KEEP_STEPS = 400
PACKS_A_BATCH = 4  # sent to a worker at once
# a pack is a row of megabytes: a writer holds, and a reader decodes, one row group at a time
PACK_FILES = {
    "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}

Wanted = Mapping[int, Sequence[ex.Expr]]


def supports(functions: Registry) -> bool:
    return all(f.kernel is not None for f in functions.values())


def _packer(first: str, values: Sequence[str], masks: Sequence[str], most: int, reach: int | None):
    """Rows sorted by series to packs of whole series with at least ``most`` rows.

    With ``reach``, a longer series is cut into pieces: each begins with copies of the ``reach`` rows before it,
    which no mask counts.
    """
    piece = None if reach is None else max(PIECE_ROWS, most, 2 * reach)

    def pack(table: pa.Table, copies: int, cut: bool) -> pa.RecordBatch:
        starts = np.union1d([0], np.flatnonzero(table[first].to_numpy()))
        sizes = np.diff(np.append(starts, len(table)))
        own = np.arange(len(table)) >= copies
        cells = [sizes.astype(np.int64).tobytes()]
        cells += [(table[m].to_numpy().astype(np.bool_) & own).tobytes() for m in masks]
        cells += [pc.fill_null(table[v], math.nan).to_numpy().astype(np.float64).tobytes() for v in values]
        arrays = [pa.array([cut or copies > 0]), *[pa.array([c], pa.binary()) for c in cells]]
        return pa.RecordBatch.from_arrays(arrays, ["cut", "sizes", *masks, *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = copies = 0
        for batch in batches:
            heads = np.flatnonzero(batch.column(first).to_numpy(zero_copy_only=False))
            if rows == copies and len(heads) and heads[0] == 0:  # the series ended with its last piece
                held, rows, copies = [], 0, 0
            if rows and len(heads) and rows + heads[-1] >= most:
                cut = int(heads[-1])
                yield pack(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks(), copies, False)
                held, rows, copies, batch = [], 0, 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
            if piece is not None and rows - copies >= piece:
                table = pa.Table.from_batches(held).combine_chunks()
                yield pack(table, copies, True)
                last = np.flatnonzero(table[first].to_numpy())
                copies = min(reach, len(table) - (int(last[-1]) if len(last) else 0))
                held, rows = table.slice(len(table) - copies).to_batches(), copies
        if rows > copies:
            yield pack(pa.Table.from_batches(held).combine_chunks(), copies, False)

    return run


class Kernel(NamedTuple):
    """What a task needs of a function."""

    call: Callable[..., np.ndarray]
    rolling: bool
    zero_guard: bool


def kernels_of(functions: Registry) -> dict[str, Kernel]:
    found = {}
    for name, f in functions.items():
        rolling = isinstance(f, WindowFunction)
        found[name] = Kernel(f.kernel, rolling, rolling and f.zero_guard)
    return found


class Evaluator:
    """Values of formulas on one pack; parts that several formulas share are computed once."""

    def __init__(
        self, segments: Segments, columns: Mapping[ex.Expr, np.ndarray], functions: Mapping[str, Kernel],
        shared: frozenset, split: bool,
    ):
        self.segments, self.functions, self.shared, self.split = segments, functions, shared, split
        self.memo = dict(columns)
        self.unknown: set[ex.Expr] = set()

    def __call__(self, expr: ex.Expr) -> np.ndarray:
        found = self.memo.get(expr)
        if found is not None:
            return found
        if not isinstance(expr, tuple):
            return np.full(self.segments.rows, float(expr))
        function = self.functions[expr[0]]
        values = [self(a) for a in expr[1:]]
        if function.rolling:
            found = function.call(values[0], self.segments, None)
            # a block of a cut series that is all zero does not tell whether the series is
            odd = self.split and function.zero_guard and self.segments.all_zero(values[0]).any()
        else:
            found, odd = function.call(*values), False
        if odd or any(a in self.unknown for a in expr[1:]):
            self.unknown.add(expr)
        if expr in self.shared:
            self.memo[expr] = found
        return found


def _nodes(expr: ex.Expr, held: Mapping[ex.Expr, str], into: set[ex.Expr]) -> None:
    if isinstance(expr, tuple) and expr not in held and expr not in into:
        into.add(expr)
        for a in expr[1:]:
            _nodes(a, held, into)


def shared_parts(exprs: Iterable[ex.Expr], held: Mapping[ex.Expr, str]) -> frozenset[ex.Expr]:
    """Parts met more than once when each distinct formula is evaluated."""
    nodes: set[ex.Expr] = set()
    top = Counter(exprs)
    for e in top:
        _nodes(e, held, nodes)
    uses = Counter(a for n in nodes for a in n[1:] if isinstance(a, tuple) and a not in held)
    return frozenset(n for n, count in (uses + top).items() if count > 1 and isinstance(n, tuple))


@dataclass(frozen=True)
class ValueStore:
    """``packs`` with the columns of ``held``: plain columns, and the formulas kept so far."""

    packs: DataFrame
    held: dict[ex.Expr, str]
    masks: int
    functions: Registry
    split: bool
    canonical: Canonical
    told: dict[tuple, moments.Score] = field(default_factory=dict)  # by mask and formula, or mask and sum of parts
    odd: set[ex.Expr] = field(default_factory=set)

    @classmethod
    def build(
        cls, series: Series, features: Sequence[str], target: str, masks: Sequence[Column], functions: Registry,
        pack_rows: int = PACK_ROWS, reach: int | None = None,
    ) -> ValueStore:
        """Write the rows of ``series`` once; a mask tells the rows a score counts, among those with a target.

        With ``reach``, the longest lookback of any formula, a pack holds a piece of a long series.
        """
        rows = series.rows
        y = F.col(target).cast("double")
        own = y.isNotNull() & ~F.isnan(y)
        if series.split:
            own &= F.col(series.helpers()[1])
        held = {c: f"v{i}" for i, c in enumerate(features)}
        flags = [F.coalesce(own & m, F.lit(False)).alias(f"m{i}") for i, m in enumerate(masks)]
        spark = rows.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / TASK_ROWS))
        dealt = rows.repartition(tasks, *series.partition)
        marked = dealt.withColumn("__first", F.row_number().over(series.ordered()) == 1)
        flat = marked.select(
            "__first", *flags, y.alias("y"), *[F.col(c).cast("double").alias(n) for c, n in held.items()]
        )
        names = [f"m{i}" for i in range(len(masks))]
        values = ["y", *held.values()]
        kinds = ", ".join(["cut boolean", *[f"{n} binary" for n in ["sizes", *names, *values]]])
        packs = flat.mapInArrow(_packer("__first", values, names, pack_rows, reach), kinds)
        packs = materialize(packs, "packs", **PACK_FILES)
        split = series.split or (reach is not None and not packs.filter("cut").isEmpty())
        return cls(packs.drop("cut"), held, len(masks), functions, split, Canonical(functions))

    def steps(self, exprs: Iterable[ex.Expr]) -> int:
        """Functions to evaluate for ``exprs`` beyond what is held."""
        nodes: set[ex.Expr] = set()
        for e in exprs:
            _nodes(self.canonical(e), self.held, nodes)
        return len(nodes)

    def _reader(self, shared: frozenset):
        held, functions, split = self.held, kernels_of(self.functions), self.split

        def read(batch: pa.RecordBatch) -> Iterator[tuple[dict, Evaluator]]:
            for row in range(batch.num_rows):
                cell = lambda n, kind=np.float64: np.frombuffer(batch.column(n)[row].as_buffer(), kind)  # noqa: B023, E731
                columns = {e: cell(n) for e, n in held.items()}
                yield cell, Evaluator(Segments(cell("sizes", np.int64)), columns, functions, shared, split)

        return read

    def keep(self, exprs: Sequence[ex.Expr]) -> ValueStore:
        """A store that holds the plain columns and ``exprs``; formulas kept before and not named are dropped."""
        exprs = [self.canonical(e) for e in exprs]
        if self.split:  # these need the whole series
            exprs = [e for e in exprs if not any(self.functions[n[0]].zero_guard for n in self._windows(e))]
        plain = {e: n for e, n in self.held.items() if isinstance(e, str)}
        kept = [e for e in dict.fromkeys(exprs) if isinstance(e, tuple)]
        held = plain | {e: f"v{len(plain) + i}" for i, e in enumerate(kept)}
        base = ["sizes", *[f"m{i}" for i in range(self.masks)], "y", *plain.values()]
        read = self._reader(shared_parts(kept, self.held))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, (_, value) in enumerate(read(batch)):
                    cells = [batch.column(n).slice(row, 1) for n in base]
                    with np.errstate(all="ignore"):
                        cells += [pa.array([np.ascontiguousarray(value(e)).tobytes()], pa.binary()) for e in kept]
                    yield pa.RecordBatch.from_arrays(cells, [*base, *[held[e] for e in kept]])

        kinds = ", ".join(f"{n} binary" for n in [*base, *[held[e] for e in kept]])
        with arrow_batches_of(self.packs.sparkSession, PACKS_A_BATCH):
            packs = materialize(self.packs.mapInArrow(run, kinds), "packs", **PACK_FILES)
        return replace(self, packs=packs, held=held)

    def _windows(self, expr: ex.Expr) -> list[tuple]:
        nodes: set[ex.Expr] = set()
        _nodes(expr, {}, nodes)
        return [n for n in nodes if isinstance(self.functions[n[0]], WindowFunction)]

    def score(self, wanted: Wanted) -> tuple[dict[tuple[int, ex.Expr], moments.Score], set[ex.Expr]]:
        """Scores by (mask, formula), and the formulas that packs alone cannot tell.

        Sums and differences come from the matrix of second moments of their parts; those whose parts cancel or are
        missing somewhere are evaluated like the others by a second pass.
        """
        named = {m: {e: self.canonical(e) for e in exprs} for m, exprs in wanted.items()}
        new = {m: [e for e in dict.fromkeys(names.values()) if (m, e) not in self.told] for m, names in named.items()}
        sign = moments.signs(self.functions)
        forms = {e: moments.linear_form(e, sign) for exprs in new.values() for e in exprs if _is_sum(e, sign)}
        key = lambda m, e: (m, forms[e][0], frozenset(forms[e][1].items()))
        for m, exprs in new.items():
            self.told.update({(m, e): self.told[key(m, e)] for e in exprs if e in forms and key(m, e) in self.told})
        new = {m: rest for m, exprs in new.items() if (rest := [e for e in exprs if (m, e) not in self.told])}
        if new:
            left = self._pass(new, forms)
            self.told.update({key(m, e): self.told[m, e] for m, exprs in new.items() for e in exprs if e in forms and (m, e) in self.told})
            if left:
                self._pass(left, {})
        scores = {(m, e): self.told[m, name] for m, names in named.items() for e, name in names.items()}
        return scores, {e for names in named.values() for e, name in names.items() if name in self.odd}

    def _pass(self, wanted: Wanted, forms: Mapping[ex.Expr, moments.Form]) -> dict[int, list[ex.Expr]]:
        """Note the scores of formulas; gives those in ``forms`` that the moments do not tell."""
        alone = {m: [e for e in exprs if e not in forms] for m, exprs in wanted.items()}
        sums = {m: [forms[e] for e in exprs if e in forms] for m, exprs in wanted.items()}
        parts = list(dict.fromkeys(p for own in sums.values() for _, weights in own for p in weights))
        number = {p: i + 1 for i, p in enumerate(parts)}
        pairs = {m: moments.pairs_of(own, number) for m, own in sums.items() if own}
        distinct = list(dict.fromkeys(e for exprs in alone.values() for e in exprs))
        asked: dict[ex.Expr, list[int]] = {}
        for m, exprs in alone.items():
            for e in exprs:
                asked.setdefault(e, []).append(m)
        read = self._reader(shared_parts([*distinct, *parts], self.held))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            single = {m: moments.PairSums(len(distinct)) for m in wanted}
            matrix = {m: moments.MatrixSums(len(parts) + 1) for m in pairs}
            with np.errstate(all="ignore"):
                for batch in batches:
                    for cell, value in read(batch):
                        y = cell("y")
                        marked = {m: moments.Marked(cell(f"m{m}", np.bool_), y) for m in wanted}
                        found = {m: {} for m, rows in marked.items() if rows.n}
                        for i, e in enumerate(distinct):
                            values = value(e)
                            for m in asked[e]:
                                single[m].bad[i] += e in value.unknown
                                if m in found:
                                    found[m][i] = marked[m].sums(values)
                        for m, sums in found.items():
                            if sums:
                                single[m].add_all(list(sums), list(sums.values()), marked[m], lambda i: value(distinct[i]))  # noqa: B023
                        for m, sums in matrix.items():
                            own = marked[m].rows
                            block = np.empty((len(parts) + 1, len(own)))
                            block[0] = marked[m].y
                            for p, i in number.items():
                                block[i] = value(p).take(own)
                                sums.bad[i] += p in value.unknown
                            sums.add(block)
                for m in wanted:
                    yield single[m].batch(m)
                for m, sums in matrix.items():
                    if sums.n:
                        yield sums.batch(m, pairs[m])

        with arrow_batches_of(self.packs.sparkSession, PACKS_A_BATCH):
            found = moments.merged(self.packs.mapInArrow(run, moments.SCHEMA)).collect()
        return self._read_off(found, wanted, forms, distinct, number)

    def _read_off(self, found, wanted: Wanted, forms, distinct: Sequence[ex.Expr], number) -> dict[int, list[ex.Expr]]:
        left = {}
        for r in found:
            if r["kind"] == moments.ALONE:
                e = distinct[r["a"]]
                if r["bad"]:
                    self.odd.add(e)
                self.told[r["mask"], e] = moments.score(*(r[n] or 0 for n in ("n", "ma", "mb", "aa", "ab", "bb", "dd")))
        for m, exprs in wanted.items():
            rows = [r for r in found if r["kind"] == moments.MATRIX and r["mask"] == m]
            matrix = moments.Matrix(rows, number)
            for e in exprs:
                if e not in forms:
                    self.told.setdefault((m, e), moments.Score(0, None, None, None))
                    continue
                told = matrix.score(forms[e])
                if told is None:
                    left.setdefault(m, []).append(e)
                else:
                    self.told[m, e] = told
        return left


def _is_sum(expr: ex.Expr, sign: Mapping[str, float]) -> bool:
    return isinstance(expr, tuple) and expr[0] in sign
