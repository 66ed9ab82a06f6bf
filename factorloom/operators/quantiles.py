"""Exact quantiles (linear interpolation) without a global sort or an unbounded buffer.

Small inputs use one ``percentile`` aggregate. Larger inputs are narrowed in rounds: a mergeable
sketch of the values around a wanted rank proposes cut points, one count per region between the
cuts proves which region holds the rank, and only the last, small region is fetched. Each round
is a narrow scan with a tiny shuffle, and the answer is exact whatever the sketch says. Values are placed between
cuts and in regions in Arrow blocks, so that only counts and the values of regions become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.tall import number, tall
from factorloom.session import materialize, setting

EXACT_ROWS = 50_000
FETCH_ROWS = 10_000
SKETCH_K = 4096
SKETCH_GROUPS = 512
MARGIN = 0.004
COLUMNS_PER_JOB = 32
FETCH_PER_JOB = 200_000

QUARTILES = (0.25, 0.5, 0.75)


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    position = (n - 1) * p
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def _around(share: float) -> list[float]:
    """A share of the rows, and a margin to each side of it."""
    return [min(max(share + m, 0.0), 1.0) for m in (-MARGIN, MARGIN)]


@dataclass
class ColumnQuantiles:
    """Values of the wanted ranks of one column."""

    n: int
    values: dict[int, float] = field(default_factory=dict)

    def at(self, p: float, low: float | None = None, high: float | None = None) -> float | None:
        """Quantile ``p``, optionally of the column clamped to [low, high]."""
        if self.n == 0:
            return None
        below, above, share = _ranks(self.n, p)
        a, b = self.values[below], self.values[above]
        if low is not None:
            a, b = max(a, low), max(b, low)
        if high is not None:
            a, b = min(a, high), min(b, high)
        return a + (b - a) * share


@dataclass
class _Region:
    """Wanted ranks of a column known to lie in [low, high]."""

    column: str
    ranks: list[int]
    below: int
    inside: int
    low: float = -math.inf
    high: float = math.inf

    def points(self) -> list[float]:
        """Shares of the region, a margin to each side of the wanted ranks."""
        shares = [(r - self.below) / max(self.inside - 1, 1) for r in self.ranks]
        return sorted({point for s in shares for point in _around(s)})


def fit_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = QUARTILES,
    exact_rows: int | None = None,
    fetch_rows: int = FETCH_ROWS,
    stored: bool = False,
) -> dict[str, ColumnQuantiles]:
    """Exact order statistics around each quantile; NULL and NaN are ignored.

    The columns are read several times, so they are written to the shared folder first unless
    the caller says that ``df`` is a stored table.
    """
    columns = list(dict.fromkeys(columns))
    if exact_rows is None:
        exact_rows = setting(df.sparkSession, "exactRows", EXACT_ROWS)
    if not columns:
        return {}
    data = df.select(*[number(c).alias(c) for c in columns])
    if not stored:
        data = materialize(data, "columns")
    shares = sorted({s for p in probabilities for s in _around(p)})
    sketched = _first_look(data, columns, shares)
    found = {c: ColumnQuantiles(n) for c, (n, _) in sketched.items()}
    wanted = {
        c: sorted({r for p in probabilities for r in _ranks(q.n, p)[:2]})
        for c, q in found.items()
        if q.n
    }
    small = [c for c in wanted if found[c].n <= exact_rows]
    _fill_small(data, {c: wanted[c] for c in small}, found)
    regions = [_Region(c, wanted[c], 0, found[c].n) for c in wanted if c not in small]
    cuts: dict[str, list[float]] | None = {r.column: sketched[r.column][1] for r in regions}
    while regions:
        _fetch(data, [r for r in regions if r.inside <= fetch_rows], found)
        regions = _narrow(data, [r for r in regions if r.inside > fetch_rows], found, cuts)
        cuts = None
    return found


def _fill_small(
    data: DataFrame, wanted: dict[str, list[int]], found: dict[str, ColumnQuantiles]
) -> None:
    if not wanted:
        return
    row = data.agg(
        *[
            F.percentile(c, [r / max(found[c].n - 1, 1) for r in ranks]).alias(f"q_{i}")
            for i, (c, ranks) in enumerate(wanted.items())
        ]
    ).first()
    for i, (c, ranks) in enumerate(wanted.items()):
        found[c].values = dict(zip(ranks, row[f"q_{i}"], strict=True))


def _chunks(sizes: dict[str, int], limit: float = math.inf) -> Iterable[list[str]]:
    """A few columns at a time, so that a job reads only those and stays within the limit."""
    chunk: list[str] = []
    held = 0
    for column, size in sizes.items():
        if chunk and (len(chunk) == COLUMNS_PER_JOB or held + size > limit):
            yield chunk
            chunk, held = [], 0
        chunk.append(column)
        held += size
    if chunk:
        yield chunk


def _jobs(regions: list[_Region], limit: float = math.inf) -> Iterable[dict[str, list[_Region]]]:
    """Regions by column, for a few columns at a time."""
    sizes: dict[str, int] = {}
    for r in regions:
        sizes[r.column] = sizes.get(r.column, 0) + r.inside
    for chunk in _chunks(sizes, limit):
        yield {
            c: sorted((r for r in regions if r.column == c), key=lambda r: r.below) for c in chunk
        }


def _values(data: DataFrame, columns: Iterable[str]) -> DataFrame:
    return tall(data, list(columns)).dropna(subset=["v"])


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The values of each column of a block that are not missing."""
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns]
        yield [x[~np.isnan(x)] for x in columns]


def _rows(names: str, columns: Sequence[Sequence]) -> pa.RecordBatch:
    kinds = {"c": pa.int32(), "g": pa.int32(), "n": pa.int64()}
    arrays = [pa.array(x, kinds.get(n, pa.float64())) for n, x in zip(names.split(), columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names.split())


def _in_regions(data: DataFrame, work: dict[str, list[_Region]]) -> DataFrame:
    """Values ``v`` of column ``c`` that lie in a region, with the number ``g`` of the region in its column."""
    lows = [np.array([r.low for r in regions]) for regions in work.values()]
    highs = [np.array([r.high for r in regions]) for regions in work.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for columns in _columns(batches):
            for c, x in enumerate(columns):
                g = np.searchsorted(lows[c], x, "right") - 1
                inside = np.flatnonzero((g >= 0) & (x <= highs[c][g]))
                if len(inside):
                    yield _rows("c g v", [np.full(len(inside), c), g[inside], x[inside]])

    return data.select(*work).mapInArrow(run, "c int, g int, v double")


def _between_cuts(data: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Count, least and largest value, numbered 2j between cut j-1 and cut j, and 2j+1 on cut j."""
    tables = [np.array(own) for own in cuts.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [[np.full(2 * len(t) + 1, start) for start in (0.0, np.inf, -np.inf)] for t in tables]
        for columns in _columns(batches):
            for x, table, (n, low, high) in zip(columns, tables, held, strict=True):
                g = np.searchsorted(table, x) + np.searchsorted(table, x, "right")
                count = np.bincount(g, minlength=len(n))
                found = np.flatnonzero(count)
                if len(found):
                    # in order of their regions; small numbers are sorted by counting
                    x = x[np.argsort(g.astype(np.int16) if len(n) < 1 << 15 else g, kind="stable")]
                    first = (np.cumsum(count) - count)[found]
                    n += count
                    low[found] = np.minimum(low[found], np.minimum.reduceat(x, first))
                    high[found] = np.maximum(high[found], np.maximum.reduceat(x, first))
        for c, (n, low, high) in enumerate(held):
            some = np.flatnonzero(n)
            if len(some):
                yield _rows("c g n low high", [np.full(len(some), c), some, n[some].astype(np.int64), low[some], high[some]])

    parts = data.select(*cuts).mapInArrow(run, "c int, g int, n bigint, low double, high double")
    return parts.groupBy("c", "g").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _sketches(tall: DataFrame, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Count ``n`` and the values ``q`` near the points, from sketches merged in two steps."""
    part = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part")
    merged = (
        tall.groupBy(*by, part)
        .agg(F.kll_sketch_agg_double("v", F.lit(SKETCH_K)).alias("s"))
        .groupBy(*by)
        .agg(F.kll_merge_agg_double("s", F.lit(SKETCH_K)).alias("s"))
    )
    asked = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(p) for p in points]))
    return merged.select(*by, F.kll_sketch_get_n_double("s").alias("n"), asked.alias("q"))


def _first_look(
    data: DataFrame, columns: list[str], points: Sequence[float]
) -> dict[str, tuple[int, list[float]]]:
    """Row count and first cut points of each column, in one scan."""
    found: dict[str, tuple[int, list[float]]] = {c: (0, []) for c in columns}
    for chunk in _chunks(dict.fromkeys(columns, 0)):
        for row in _sketches(_values(data, chunk), ["c"], points).collect():
            found[chunk[row["c"]]] = (row["n"], sorted(set(row["q"])))
    return found


def _cuts(data: DataFrame, work: dict[str, list[_Region]]) -> dict[str, list[float]]:
    """Cut points around the wanted ranks of each region."""
    points = sorted({p for regions in work.values() for r in regions for p in r.points()})
    rows = _sketches(_in_regions(data, work), ["c", "g"], points).collect()
    answers = {(r["c"], r["g"]): dict(zip(points, r["q"], strict=True)) for r in rows}
    return {
        c: sorted({answers[i, g][p] for g, r in enumerate(regions) for p in r.points()})
        for i, (c, regions) in enumerate(work.items())
    }


def _narrow(
    data: DataFrame,
    regions: list[_Region],
    found: dict[str, ColumnQuantiles],
    known: dict[str, list[float]] | None = None,
) -> list[_Region]:
    """Count the regions between the cuts and keep those that hold a wanted rank.

    Cuts are values of the column and form regions of their own, so a round always makes
    progress, also when one value fills most of the column.
    """
    open_regions: list[_Region] = []
    for work in _jobs(regions):
        cuts = {c: known[c] for c in work} if known else _cuts(data, work)
        rows = _between_cuts(data, cuts).collect()
        for i, (c, parents) in enumerate(work.items()):
            wanted = sorted(rank for r in parents for rank in r.ranks)
            reached = 0
            for row in sorted((r for r in rows if r["c"] == i), key=lambda r: r["g"]):
                held = [r for r in wanted if reached <= r < reached + row["n"]]
                if held and row["low"] == row["high"]:
                    found[c].values.update(dict.fromkeys(held, row["low"]))
                elif held:
                    open_regions.append(
                        _Region(c, held, reached, row["n"], row["low"], row["high"])
                    )
                reached += row["n"]
    return open_regions


def _fetch(data: DataFrame, regions: list[_Region], found: dict[str, ColumnQuantiles]) -> None:
    """Read the few values of small regions and pick the ranks."""
    for work in _jobs(regions, FETCH_PER_JOB):
        rows = (
            _in_regions(data, work).groupBy("c", "g", "v").agg(F.count(F.lit(1)).alias("n")).collect()
        )
        held: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for row in rows:
            held.setdefault((row["c"], row["g"]), []).append((row["v"], row["n"]))
        for i, (c, regions_here) in enumerate(work.items()):
            for g, region in enumerate(regions_here):
                wanted, reached = sorted(region.ranks), region.below
                for value, n in sorted(held[i, g]):
                    while wanted and wanted[0] < reached + n:
                        found[c].values[wanted.pop(0)] = value
                    reached += n
