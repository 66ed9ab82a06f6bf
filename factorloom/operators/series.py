"""Per-instrument windows that stay balanced when one instrument holds most of the rows.

A plain window puts a whole instrument into one task. Here instruments above
``block_rows`` are cut into consecutive blocks of whole time slices. Slices next to a block's
edge are copied into it, so every row still sees its full frame; the copies are dropped
afterwards. Without such instruments the plan is the plain one with a single exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.operators.joins import null_safe_join
from factorloom.operators.ranks import running_counts
from factorloom.session import materialize, scratch_path, setting

BLOCK_ROWS = 2_000_000
BUCKET_ROWS = 2_000_000
NUMBERS_PER_SLICE = 1_000
KEYS = ("order_book_id",)
ORDER = ("date",)

_BLOCK = "__block"
_OWN = "__own"
_SLICE = "__slice"


@dataclass(frozen=True)
class Series:
    """Rows laid out for windows; ``rows`` may hold edge copies until ``own`` is called."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False
    table: str | None = None

    @property
    def partition(self) -> tuple[str, ...]:
        return self.keys + ((_BLOCK,) if self.split else ())

    def over(self, start: int, end: int) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order).rowsBetween(start, end)

    def trailing(self, size: int) -> WindowSpec:
        return self.over(1 - size, 0)

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def with_rows(self, rows: DataFrame) -> Series:
        return replace(self, rows=rows)

    def own(self) -> DataFrame:
        """The original rows, without edge copies and helper columns."""
        if not self.split:
            return self.rows
        return self.rows.filter(F.col(_OWN)).drop(_BLOCK, _OWN)

    def helpers(self) -> list[str]:
        return [_BLOCK, _OWN] if self.split else []

    def store(self, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS) -> Series:
        """Write the layout once, bucketed and sorted, so later windows need no shuffle.

        A bucket is one task, so their number follows the rows. ``drop`` removes the table.
        """
        spark = self.rows.sparkSession
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if buckets is None:
            buckets = max(least, math.ceil(self.rows.count() / bucket_rows))
        count = min(buckets, most)
        path = scratch_path(spark, "series")
        name = "factorloom_" + path.rsplit("-", 1)[1]
        (
            self.rows.repartition(count, *self.partition)
            .write.option("path", path)
            .bucketBy(count, *self.partition)
            .sortBy(*self.partition, *self.order)
            .saveAsTable(name)
        )
        return replace(self, rows=spark.table(name), table=name)

    def drop(self) -> None:
        """Remove a stored layout from the catalog; its files stay with the scratch folder."""
        if self.table:
            self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")

    def every_row(self, flags: dict[str, Column]) -> tuple[Series, dict[str, Column]]:
        """For each condition, a column telling whether it holds on all rows of the instrument."""
        if not flags:
            return self, {}
        if not self.split:
            whole = self.over(Window.unboundedPreceding, Window.unboundedFollowing)
            return self, {n: F.bool_and(c).over(whole) for n, c in flags.items()}
        found = (
            self.rows.filter(F.col(_OWN))
            .groupBy(*self.keys)
            .agg(*[F.bool_and(c).alias(n) for n, c in flags.items()])
            .filter(reduce(Column.__or__, [F.col(n) for n in flags]))
        )
        if found.isEmpty():
            return self, {n: F.lit(False) for n in flags}
        rows = null_safe_join(self.rows, found, self.keys)
        return self.with_rows(rows), {n: F.coalesce(F.col(n), F.lit(False)) for n in flags}


def time_slice(df: DataFrame, column: str) -> Column:
    """A short stretch of the order: a minute, a thousand numbers, or else the value itself."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("minute", F.col(column))
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / NUMBERS_PER_SLICE)
    return F.col(column)


def lay_out(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    before: int = 0,
    after: int = 0,
    block_rows: int | None = None,
) -> Series:
    """Prepare ``df`` for frames reaching ``before`` rows back, or ``after`` rows ahead.

    ``order`` must be unique within an instrument. One narrow count job decides whether any
    instrument needs to be cut.
    """
    if before and after:
        raise ValueError("frames may reach back or ahead, not both")
    keys, order = tuple(keys), tuple(order)
    block_rows = block_rows or setting(df.sparkSession, "blockRows", BLOCK_ROWS)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.filter(F.col("__n") > block_rows).drop("__n")
    if large.isEmpty():
        return Series(df, keys, order)
    return _cut(df, materialize(large, "large"), keys, order, before, after, block_rows)


def _slice_counts(
    df: DataFrame,
    large: DataFrame,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    block_rows: int,
) -> tuple[Column, DataFrame]:
    """How slices are made, and the rows per slice of the large instruments.

    Slices that would still exceed a block fall back to single places in the order.
    """
    marked = large.withColumn("__large", F.lit(True))
    for unit in (time_slice(df, order[0]), F.struct(*order)):
        counts = df.groupBy(*keys, unit.alias(_SLICE)).agg(F.count(F.lit(1)).alias("n"))
        counts = null_safe_join(counts, marked, keys).filter(F.col("__large")).drop("__large")
        counts = materialize(counts, "slices")
        if counts.agg(F.max("n")).first()[0] <= block_rows:
            break
    return unit, counts


def _cut(
    df: DataFrame,
    large: DataFrame,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    before: int,
    after: int,
    block_rows: int,
) -> Series:
    unit, counts = _slice_counts(df, large, keys, order, block_rows)
    # looking ahead is looking back with positions counted from the other end
    placed = running_counts(counts, keys, _SLICE)
    start = F.col("total") - F.col("before") - F.col("n") if after else F.col("before")
    placed = placed.withColumn("__start", start).withColumn("__end", start + F.col("n"))
    home = F.floor(F.col("__start") / block_rows)
    targets = F.array(home)
    reach = max(before, after)
    if reach:
        # the blocks of the next ``reach`` rows after the slice need it in their frames
        first = F.floor(F.col("__end") / block_rows)
        last = F.floor((F.col("__end") + (reach - 1)) / block_rows)
        later = F.when(F.col("__end") < F.col("total"), F.sequence(first, last))
        targets = F.array_distinct(F.concat(targets, F.coalesce(later, targets)))
    on = (*keys, _SLICE)
    blocks = placed.select(*on, home.alias("__home"), targets.alias("__targets"))
    # the map is the small side: hashing it spares the rows a sort they would lose again
    rows = null_safe_join(df.withColumn(_SLICE, unit), blocks.hint("shuffle_hash"), on)
    rows = rows.withColumn(
        _BLOCK, F.explode(F.coalesce("__targets", F.array(F.lit(0).cast("bigint"))))
    )
    rows = rows.withColumn(
        _OWN, F.col("__home").isNull() | (F.col("__home") == F.col(_BLOCK))
    ).drop(_SLICE, "__home", "__targets")
    return Series(rows, keys, order, split=True)


def forward_return(
    df: DataFrame,
    price: str = "open",
    horizon: int = 20,
    target: str = "target_feature",
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block_rows: int | None = None,
    infinite: bool = False,
) -> DataFrame:
    """Relative change of ``price`` ``horizon`` rows ahead, per instrument.

    A zero price gives NULL, or a signed infinity with ``infinite=True``.
    """
    series = lay_out(df, keys, order, after=horizon, block_rows=block_rows)
    ahead = F.lead(price, horizon).over(series.ordered())
    value = F.try_divide(ahead - F.col(price), F.col(price))
    if infinite:
        endless = F.signum(ahead) * float("inf")
        value = F.when((F.col(price) == 0) & (ahead != 0), endless).otherwise(value)
    return series.with_rows(series.rows.withColumn(target, value)).own()


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block_rows: int | None = None,
) -> DataFrame:
    """Forward fill, then backward fill, then 0, per instrument."""
    series = lay_out(df, keys, order, block_rows=block_rows)
    to_here = series.over(Window.unboundedPreceding, 0)
    # the next value is the last one in descending order: a growing frame, where a frame from each
    # row to the end would be read anew for every row
    back = Window.partitionBy(*series.partition).orderBy(*[F.col(c).desc() for c in series.order])
    from_here = back.rowsBetween(Window.unboundedPreceding, 0)
    rows = series.rows.withColumns(
        {f"__f_{c}": F.last(c, ignorenulls=True).over(to_here) for c in columns}
    ).withColumns({f"__b_{c}": F.last(c, ignorenulls=True).over(from_here) for c in columns})
    fills = {c: [F.col(f"__f_{c}"), F.col(f"__b_{c}")] for c in columns}
    if series.split:
        rows = _carry_across_blocks(series, rows, columns)
        fills = {
            c: [F.col(f"__f_{c}"), F.col(f"__fc_{c}"), F.col(f"__b_{c}"), F.col(f"__bc_{c}")]
            for c in columns
        }
    filled = rows.withColumns({c: F.coalesce(*fills[c], F.lit(0.0)) for c in columns})
    return series.with_rows(filled.select(*df.columns, *series.helpers())).own()


def _carry_across_blocks(series: Series, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join the last value before and the first value after each block of an instrument."""
    place = F.struct(*series.order)
    edges = rows.groupBy(*series.partition).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__l_{c}") for c in columns],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__s_{c}") for c in columns],
    )
    blocks = Window.partitionBy(*series.keys).orderBy(_BLOCK)
    past = blocks.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*series.keys).orderBy(F.col(_BLOCK).desc())
    future = back.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *series.partition,
        *[F.last(f"__l_{c}", ignorenulls=True).over(past).alias(f"__fc_{c}") for c in columns],
        *[F.last(f"__s_{c}", ignorenulls=True).over(future).alias(f"__bc_{c}") for c in columns],
    )
    return null_safe_join(rows, carried, series.partition)
