"""Bars and wide factors stored alike by key, so that they meet without a shuffle.

Both tables are bucketed by day and instrument with one bucket count, so a task joins one bucket of each as the files
lie. The hash takes both keys: an instrument that holds a third of all rows fills every bucket evenly. Factors lie in
groups of ``width`` columns, one folder a group, and are appended group by group: thousands of names never meet in one
aggregate, and a read opens only the groups of the names it wants. Rows within a bucket are ordered by day, so ranges
of days skip row groups.

A bucketed folder can only be read through a catalog entry. Entries have random names, live while a plan is made or
a write runs, and are dropped with the files left in place.

Cases: rows without a day or an instrument are not stored with factors and keep empty factors as bars; NULL, NaN and
infinite factor values count as missing; repeated keys of a factor are averaged; a factor's keys take the types of the
bars' keys. A name that is stored already, or is a column of the bars, is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from factorloom.functions.scalars import finite
from factorloom.operators.reshape import FACTOR_KEYS
from factorloom.sources.tables import read_if_present

GROUP = "column_group"
WIDTH = 256
ROWS_PER_BUCKET = 500_000
MOST_BUCKETS = 100_000  # Spark's own limit, spark.sql.sources.bucketing.maxBuckets
MOST_NAMES = 100_000  # names are columns of a plan and a broadcast list
NAMES = f"factor_name string, {GROUP} string, slot int"
LAYOUT = "buckets int, width int, bars string"


def _slots(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


class AlignedStore:
    """A folder with bars and the factors beside them; ``create`` makes one, the constructor opens one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        layout = spark.read.schema(LAYOUT).json(f"{self.path}/layout").first()
        self.buckets, self.width = layout["buckets"], layout["width"]
        self.schema = StructType.fromJson(json.loads(layout["bars"]))
        keys = [f for f in self.schema if f.name in FACTOR_KEYS]
        slots = [StructField(c, DoubleType()) for c in _slots(self.width)]
        self.factor_schema = StructType([*keys, *slots, StructField(GROUP, StringType())])

    @classmethod
    def create(
        cls, bars: DataFrame, path: str, buckets: int | None = None, width: int = WIDTH
    ) -> AlignedStore:
        """Write the bars to a new folder. Without ``buckets`` their number follows the rows.

        The layout is written last: a folder without one, left by a write that stopped, is written anew.
        """
        spark, path = bars.sparkSession, path.rstrip("/")
        if _is_there(spark, f"{path}/layout/_SUCCESS"):
            raise ValueError(f"{path} holds a store already")
        if buckets is None:
            buckets = min(max(1, -(-bars.count() // ROWS_PER_BUCKET)), MOST_BUCKETS)
        _insert(bars, f"{path}/bars", bars.schema, buckets, anew=True)
        layout = spark.createDataFrame([(buckets, width, bars.schema.json())], LAYOUT)
        layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")
        return cls(spark, path)

    def places(self) -> dict[str, tuple[str, str]]:
        """Column group and column of every stored factor."""
        found = read_if_present(self.spark, f"{self.path}/names")
        if found is None:
            return {}
        return {r["factor_name"]: (r[GROUP], f"c{r['slot']}") for r in found.collect()}

    def add_factors(self, factors: DataFrame, names: Sequence[str] | None = None) -> list[str]:
        """Append the factors of a long table as new column groups; gives their names.

        The list of names is written after the values, so a write that stopped leaves a group nobody reads.
        """
        if names is None:
            named = factors.filter(F.col("factor_name").isNotNull())
            listed = named.select("factor_name").distinct().limit(MOST_NAMES + 1).collect()
            names = sorted(r["factor_name"] for r in listed)
        names = list(dict.fromkeys(names))
        if len(names) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} factor names")
        known = set(self.places())
        taken = [n for n in names if n in known or n in self.schema.names]
        if taken:
            raise ValueError(f"already stored: {', '.join(taken)}")
        if not names:
            return []
        label = uuid.uuid4().hex
        rows = [(n, f"{label}-{i // self.width}", i % self.width) for i, n in enumerate(names)]
        places = self.spark.createDataFrame(rows, NAMES)
        self._insert_factors(self._packed(factors, places))
        places.coalesce(1).write.mode("append").parquet(f"{self.path}/names")
        return names

    def add_days(self, bars: DataFrame, factors: DataFrame | None = None) -> None:
        """Append the bars, and the values of the stored factors, of days not stored yet.

        Days that a table holds already stay as they are, so an addition that stopped between its two writes is
        finished by repeating it. Rows without a day belong to no day and are not added.
        """
        held = self.bars().select("date").distinct()
        fresh = bars.filter("date is not null").join(held, "date", "left_anti")
        _insert(fresh, f"{self.path}/bars", self.schema, self.buckets)
        places = read_if_present(self.spark, f"{self.path}/names")
        if factors is not None and places is not None:
            rows = self._packed(factors, places)
            stored = read_if_present(self.spark, f"{self.path}/factors", self.factor_schema)
            held = stored.select(GROUP, "date").distinct()
            self._insert_factors(rows.join(held, [GROUP, "date"], "left_anti"))

    def bars(self) -> DataFrame:
        return _bucketed(self.spark, f"{self.path}/bars", self.schema, self.buckets)

    def attach(self, names: Sequence[str] | None = None, bars: DataFrame | None = None) -> DataFrame:
        """The stored bars with factor columns beside them, without a shuffle of either.

        ``bars`` is a selection of ``self.bars()`` that keeps both keys.
        """
        return self._beside(self.bars() if bars is None else bars, self._grouped(names))

    def wide(self, names: Sequence[str] | None = None) -> DataFrame:
        """One row per key with a value of any of the factors. Without a shuffle, but of the keys when the names lie in several groups."""
        grouped = self._grouped(names)
        if not grouped:
            return self.bars().select(*FACTOR_KEYS).limit(0)
        parts = []
        for group, columns in grouped.items():
            some = F.coalesce(*[F.col(c) for c in columns.values()]).isNotNull()
            parts.append(self._group(group).filter(some).select(*FACTOR_KEYS))
        return self._beside(reduce(DataFrame.union, parts).distinct(), grouped)

    def _grouped(self, names: Sequence[str] | None) -> dict[str, dict[str, str]]:
        places = self.places()
        wanted = sorted(places) if names is None else list(dict.fromkeys(names))
        unknown = [n for n in wanted if n not in places]
        if unknown:
            raise ValueError(f"no such factor: {', '.join(unknown)}")
        grouped: dict[str, dict[str, str]] = {}
        for name in wanted:
            group, column = places[name]
            grouped.setdefault(group, {})[name] = column
        return grouped

    def _beside(self, rows: DataFrame, grouped: dict[str, dict[str, str]]) -> DataFrame:
        for group, columns in grouped.items():
            part = self._group(group)
            part = part.select(*FACTOR_KEYS, *[F.col(c).alias(n) for n, c in columns.items()])
            rows = rows.join(part, list(FACTOR_KEYS), "left")
        return rows

    def _group(self, group: str) -> DataFrame:
        schema = StructType([f for f in self.factor_schema if f.name != GROUP])
        return _bucketed(self.spark, f"{self.path}/factors/{GROUP}={group}", schema, self.buckets)

    def _packed(self, factors: DataFrame, places: DataFrame) -> DataFrame:
        """One row per key and column group. Repeats are averaged before the rows of a key come together."""
        types = {f.name: f.dataType for f in self.factor_schema if f.name in FACTOR_KEYS}
        valued = factors.select(
            *[F.col(k).cast(types[k]).alias(k) for k in FACTOR_KEYS],
            "factor_name",
            finite(F.col("factor_value").cast("double")).alias("factor_value"),
        ).dropna("any")
        placed = valued.join(F.broadcast(places), "factor_name")
        means = placed.groupBy(*FACTOR_KEYS, GROUP, "slot").agg(F.avg("factor_value").alias("mean"))
        together = means.repartition(self.buckets, *FACTOR_KEYS)
        slots = together.groupBy(*FACTOR_KEYS, GROUP).pivot("slot", list(range(self.width)))
        packed = slots.agg(F.first("mean"))
        return packed.withColumnsRenamed({str(i): c for i, c in enumerate(_slots(self.width))})

    def _insert_factors(self, rows: DataFrame) -> None:
        _insert(rows, f"{self.path}/factors", self.factor_schema, self.buckets)


@contextmanager
def _entry(spark: SparkSession, path: str, schema: StructType, buckets: int) -> Iterator[str]:
    """A catalog entry for the folder, dropped afterwards; the files stay."""
    name = f"factorloom_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join(f"`{k}`" for k in FACTOR_KEYS)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    folders = f"PARTITIONED BY ({GROUP}) " if GROUP in schema.names else ""
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet {folders}"
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _insert(rows: DataFrame, path: str, schema: StructType, buckets: int, anew: bool = False) -> None:
    """Append rows, one file a bucket: the exchange deals rows the way buckets are numbered. ``anew`` replaces all."""
    with _entry(rows.sparkSession, path, schema, buckets) as name:
        rows.repartition(buckets, *FACTOR_KEYS).select(*schema.names).write.insertInto(name, overwrite=anew)


def _bucketed(spark: SparkSession, path: str, schema: StructType, buckets: int) -> DataFrame:
    with _entry(spark, path, schema, buckets) as name:
        return spark.table(name)
