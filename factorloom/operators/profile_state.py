"""Profiles that are kept per date folder and merged, so that a refresh reads the touched dates only.

For each period (a day unless ``grain`` says otherwise) and column two things are stored:

* ``days``: counts, central moments, extremes, a quantile sketch and a distinct sketch;
* ``blocks``: the distinct values in order with how often they occur, at most ``BLOCK_VALUES`` to a row, beside the row's
  lowest and highest value.

Moments and sketches merge. Exact ranks are proved by counts: the merged sketch proposes cuts, blocks between two cuts
count as a whole, and only blocks around a cut are opened. The profiled table itself is never read again.

Cases: NULL and NaN are missing values; a touched period without rows is emptied; rows without a date are a
period that only a full refresh sets; columns are numbers; a refresh that was stopped between its two writes is found
by ``check``, which ``profile`` calls, and has to be repeated.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.profile import IQR_REACH, REPORT_QUANTILES
from factorloom.operators.quantiles import FETCH_ROWS, SKETCH_K, ColumnQuantiles, _around, _ranks
from factorloom.operators.tall import named, tall
from factorloom.session import materialize, shuffles_for
from factorloom.sources.tables import as_date

BLOCK_BITS = 12
BLOCK_VALUES = 2**BLOCK_BITS
TASK_ROWS = 1_000_000  # values that a task of a refresh orders
NARROWING = 16  # regions a round cuts a wide region into
GRAINS = {"day": {}, "month": {"day": 1}, "year": {"month": 1, "day": 1}}
NO_COLUMN = -1  # marks a touched period, so that one without rows is written as well

SCHEMAS = {
    "days": "c int, rows bigint, n bigint, infinite bigint, zero bigint, positive bigint, negative bigint, mean double, "
    "min double, max double, sketch binary, distinct binary, m2 double, m3 double, m4 double, stamp string, part date",
    "blocks": "c int, low double, high double, n bigint, size bigint, held array<struct<v: double, n: bigint>>, "
    "stamp string, part date",
}

_COUNTS = ("rows", "n", "infinite", "zero", "positive", "negative")


class ProfileState:
    """The stored profile of ``columns`` of a table with dates."""

    def __init__(
        self, spark: SparkSession, path: str, columns: Sequence[str], date: str = "date", grain: str = "day"
    ):
        if grain not in GRAINS:
            raise ValueError(f"grain is one of {', '.join(GRAINS)}")
        self.spark, self.path, self.columns = spark, path.rstrip("/"), list(columns)
        self.date, self.grain = date, grain

    # ---- refresh -----------------------------------------------------------------------------

    def _period(self) -> Column:
        day = F.col(self.date).cast("date")
        return day if self.grain == "day" else F.trunc(day, self.grain).cast("date")

    def refresh(self, df: DataFrame, days: Iterable[str | dt.date] | None = None) -> None:
        """Set the state of the periods of ``days`` from ``df``, or of all of them; other periods are not read."""
        touched = None
        if days is not None:
            touched = sorted({as_date(d).replace(**GRAINS[self.grain]) for d in days})
            if not touched:
                return
            df = df.filter(self._period().isin(touched))
        rows = df.select(self._period().alias("part"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(self.columns)])
        values = tall(rows, [f"c_{i}" for i in range(len(self.columns))], ["part"])
        values = materialize(values.withColumn("v", F.col("v") + 0.0), "profile")  # no negative zeros
        stamp = uuid.uuid4().hex
        with shuffles_for(self.spark, values.count(), TASK_ROWS):
            self._write(_blocks(values), "blocks", touched, stamp, "c", "low")
            self._write(_days(values), "days", touched, stamp, "c")

    def _write(self, state: DataFrame, name: str, touched: list[dt.date] | None, stamp: str, *order: str) -> None:
        if touched is not None:
            marks = self.spark.createDataFrame([(d, NO_COLUMN) for d in touched], "part date, c int")
            state = state.unionByName(marks, allowMissingColumns=True)
        state = state.withColumn("stamp", F.lit(stamp)).hint("rebalance", "part").sortWithinPartitions("part", *order)
        mode = "static" if touched is None else "dynamic"
        writer = state.write.mode("overwrite").option("partitionOverwriteMode", mode)
        writer.partitionBy("part").parquet(f"{self.path}/{name}")

    # ---- reading -----------------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _read(self, name: str, column: str | None = None) -> DataFrame:
        chosen = F.col("c") >= 0 if column is None else F.col("c") == self.columns.index(column)
        return self._table(name).filter(chosen)

    def check(self) -> None:
        """Raise if a refresh has set only one of the two tables of a period."""
        stamps = [self._table(t).select("part", "stamp").distinct() for t in SCHEMAS]
        # a period that holds missing values only has no blocks
        torn = stamps[1].exceptAll(stamps[0]).limit(1).collect()
        if torn:
            raise ValueError(f"the refresh of {torn[0]['part']} did not end; refresh it again")

    def _merged(self, column: str | None = None) -> DataFrame:
        """Per column ``c``: counts, mean, central sums and extremes of all periods."""
        days = self._read("days", column)
        weighted = F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("mean")))
        means = days.groupBy("c").agg((weighted / F.sum("n")).alias("center"))
        n, shift = F.col("n").cast("double"), F.col("mean") - F.col("center")
        m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
        merged = days.join(means, "c").groupBy("c").agg(
            *[F.sum(c).alias(c) for c in _COUNTS],
            F.first("center").alias("mean"),
            F.sum(m2 + n * shift**2).alias("m2"),
            F.sum(m3 + 3 * shift * m2 + n * shift**3).alias("m3"),
            F.sum(m4 + 4 * shift * m3 + 6 * shift**2 * m2 + n * shift**4).alias("m4"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
        flat = F.col("min") == F.col("max")
        return merged.withColumns({m: F.when(flat, 0.0).otherwise(F.col(m)) for m in ("m2", "m3", "m4")})

    def null_profile(self) -> DataFrame:
        """Missing count and percentage of the columns that have any."""
        nulls = F.col("rows") - F.col("n")
        found = self._merged().select("c", nulls.alias("nulls"), (nulls / F.col("rows") * 100).alias("percent"))
        return named(found.filter("nulls > 0"), self.columns)

    def feature_quality(self) -> DataFrame:
        """Per column: missing percentage, zero percentage, sample std."""
        rows = F.col("rows")
        found = self._merged().select(
            "c",
            ((rows - F.col("n")) / rows * 100).alias("missing_pct"),
            (F.col("zero") / rows * 100).alias("zero_pct"),
            _std().alias("std"),
        )
        return named(found, self.columns)

    def distinct(self, column: str, exact: bool = True) -> int:
        if exact:
            held = self._read("blocks", column).select(F.explode("held.v").alias("v"))
            return held.distinct().count()
        union = F.hll_sketch_estimate(F.hll_union_agg("distinct"))
        return self._read("days", column).filter("n > 0").agg(union).first()[0] or 0

    def quantiles(self, column: str, probabilities: Sequence[float] = REPORT_QUANTILES) -> ColumnQuantiles:
        """Exact order statistics around each quantile, from the stored blocks."""
        sketch = F.kll_merge_agg_double("sketch", F.lit(SKETCH_K))
        points = sorted({s for p in probabilities for s in _around(p)})
        days = self._read("days", column).filter("n > 0").agg(F.sum("n").alias("n"), sketch.alias("s"))
        asked = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(p) for p in points]))
        first = days.select("n", F.when(F.col("n") > 0, asked).alias("q")).first()
        found = ColumnQuantiles(first["n"] or 0)
        if not found.n:
            return found
        ranks = sorted({r for p in probabilities for r in _ranks(found.n, p)[:2]})
        cuts = sorted(set(first["q"]))
        while ranks:
            ranks, cuts = self._narrow(column, ranks, cuts, found)
        return found

    def _narrow(
        self, column: str, ranks: list[int], cuts: list[float], found: ColumnQuantiles
    ) -> tuple[list[int], list[float]]:
        """Settle the ranks whose region is small; the other ranks, and cuts through their regions."""
        reached, left, more = 0, [], []
        for row in self._counts(column, cuts):
            held = [r for r in ranks if reached <= r < reached + row["n"]]
            if held and row["low"] == row["high"]:
                found.values.update(dict.fromkeys(held, row["low"]))
            elif held and row["size"] <= FETCH_ROWS:
                at = reached
                for value, n in self._values(column, row["low"], row["high"]):
                    found.values.update(dict.fromkeys([r for r in held if at <= r < at + n], value))
                    at += n
            elif held:
                left += held
                more += [row["low"], row["high"], *self._middles(column, row["low"], row["high"])]
            reached += row["n"]
        return left, sorted(set(more))

    def _counts(self, column: str, cuts: Sequence[float]) -> list[Row]:
        """Values (n), entries (size), lowest and highest of each region: 2j below cut j, 2j + 1 on it."""
        blocks = self._read("blocks", column)
        edges = F.array(*[F.lit(float(c)) for c in cuts])

        def region(x: str) -> Column:
            return F.size(F.filter(edges, lambda e: e < F.col(x))) + F.size(F.filter(edges, lambda e: e <= F.col(x)))

        around = reduce(lambda a, b: a | b, [(F.col("low") <= c) & (F.col("high") >= c) for c in map(float, cuts)])
        whole = blocks.filter(~around).select(region("low").alias("g"), "n", "size", "low", "high")
        opened = blocks.filter(around).select(F.inline("held"))
        one = opened.select(region("v").alias("g"), "n", F.lit(1).cast("long").alias("size"), "v", "v")
        both = whole.union(one.toDF("g", "n", "size", "low", "high"))
        sums = [F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high")]
        return both.groupBy("g").agg(*sums).orderBy("g").collect()

    def _between(self, column: str, low: float, high: float) -> DataFrame:
        near = (F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low))
        held = self._read("blocks", column).filter(near).select(F.inline("held"))
        return held.filter(F.col("v").between(low, high))

    def _values(self, column: str, low: float, high: float) -> list[tuple[float, int]]:
        rows = self._between(column, low, high).groupBy("v").agg(F.sum("n").alias("n")).collect()
        return sorted((r["v"], r["n"]) for r in rows)

    def _middles(self, column: str, low: float, high: float) -> list[float]:
        sketch = F.kll_sketch_agg_double("v", F.lit(SKETCH_K))
        points = F.array(*[F.lit(i / NARROWING) for i in range(1, NARROWING)])
        found = self._between(column, low, high).agg(F.kll_sketch_get_quantile_double(sketch, points))
        return found.first()[0]

    def profile(self, column: str, exact: bool = True) -> DataFrame:
        """The row that ``profile_target`` gives for the whole table; ``exact`` concerns distinct values only."""
        self.check()
        marks = self.quantiles(column, REPORT_QUANTILES)
        low, high = marks.at(0.25), marks.at(0.75)
        outside, bounds = 0, (None, None, None)
        if marks.n:
            spread = high - low
            bounds = (spread, low - IQR_REACH * spread, high + IQR_REACH * spread)
            if bounds[1] == bounds[1] and bounds[2] == bounds[2]:
                counted = self._counts(column, sorted({bounds[1], bounds[2]}))
                last = 4 if bounds[1] < bounds[2] else 2
                outside = sum(r["n"] for r in counted if r["g"] in (0, last))
        merged = self._merged(column)
        row = merged.groupBy().agg(*[F.max(c).alias(c) for c in merged.columns if c != "c"])
        n, total, missing = F.col("n").cast("double"), F.col("rows"), F.col("rows") - F.col("n")
        row = row.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in _COUNTS})
        skew = F.sqrt(n) * F.col("m3") / F.col("m2") ** 1.5 * F.sqrt(n * (n - 1)) / (n - 2)
        excess = n * F.col("m4") / F.col("m2") ** 2 - 3
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6)
        flat = F.col("m2") == 0
        double = lambda x: F.lit(x).cast("double")
        signs = ("zero", "positive", "negative")
        return row.select(
            "rows",
            F.col("n").alias("count"),
            "mean",
            _std().alias("std"),
            F.when(n >= 3, F.when(flat, 0.0).otherwise(F.nanvl(skew, F.lit(0.0)))).alias("skew"),
            F.when(n >= 4, F.when(flat, 0.0).otherwise(kurt)).alias("kurt"),
            "min",
            "max",
            (F.col("max") - F.col("min")).alias("range"),
            *[F.col(s).alias(f"{s}_count") for s in signs],
            *[F.try_divide(s, total).alias(f"{s}_ratio") for s in signs],
            double(low).alias("q1"),
            double(high).alias("q3"),
            *[double(b).alias(a) for a, b in zip(("iqr", "lower_bound", "upper_bound"), bounds, strict=True)],
            F.lit(outside).cast("long").alias("outlier_count"),
            F.try_divide(F.lit(outside), total).alias("outlier_ratio"),
            missing.alias("missing_count"),
            F.col("infinite").alias("infinite_count"),
            ((missing == 0) & (F.col("infinite") == 0)).alias("quality_ok"),
            *[double(marks.at(p)).alias(f"q{round(p * 100):02d}") for p in REPORT_QUANTILES],
            double(marks.at(0.5)).alias("median"),
            F.lit(self.distinct(column, exact)).cast("long").alias("distinct_values"),
        )


def _std() -> Column:
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))


def _days(values: DataFrame) -> DataFrame:
    v = F.col("v")
    found = values.groupBy("part", "c").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("n"),
        F.count_if(F.abs(v) == float("inf")).alias("infinite"),
        F.count_if(v == 0).alias("zero"),
        F.count_if(v > 0).alias("positive"),
        F.count_if(v < 0).alias("negative"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("var"),
        F.skewness(v).alias("skew"),
        F.kurtosis(v).alias("kurt"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("sketch"),
        F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v))).alias("distinct"),
    )
    n, var = F.col("n").cast("double"), F.col("var")
    sums = {
        "m2": var * n,
        "m3": F.coalesce(F.col("skew") * var**1.5 * n, var * 0),
        "m4": F.coalesce((F.col("kurt") + 3) * var**2 * n, var * 0),
    }
    return found.withColumns(sums).drop("var", "skew", "kurt")


def _blocks(values: DataFrame) -> DataFrame:
    """Distinct values in order, BLOCK_VALUES to a row; a hot period is spread over tasks by ranges of values."""
    counted = values.dropna(subset=["v"]).groupBy("part", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    order = ["part", "c", "v"]
    placed = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    return placed.groupBy("part", "c", "block").agg(
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("size"),
        F.sort_array(F.collect_list(F.struct("v", "n"))).alias("held"),
    ).drop("block")
