"""Keep a stored table up to date against the trading calendar.

Only date bounds and the list of missing trading days (at most one per calendar day) reach the
driver; rows go from the source to the table in one job. A run that is repeated after a failure
rewrites the same partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.schema import format_table
from factorloom.sources.calendar import GLOBAL_START, folder_dates, missing_dates, new_dates
from factorloom.sources.tables import TableConfig, as_date, read_if_present, write_table

Fetch = Callable[[dt.date, dt.date], DataFrame]


@dataclass(frozen=True)
class RefreshJob:
    """A table, its calendar, and the source hook ``fetch(start, end)``."""

    spark: SparkSession
    config: TableConfig
    path: str
    calendar: DataFrame
    fetch: Fetch

    def fetch_range(self, start: str | dt.date, end: str | dt.date, sort: bool = True) -> DataFrame:
        return format_table(self.fetch(as_date(start), as_date(end)), self.config.schema, sort=sort)

    def stored(self) -> DataFrame | None:
        return read_if_present(self.spark, self.path, self.config.schema)

    def dates(self) -> DataFrame:
        """The stored dates, from folder names where the table has folders by date."""
        return folder_dates(self.spark, self.path, self.config)

    def full(self, as_of: str | dt.date) -> None:
        self._write(self.fetch_range(GLOBAL_START, as_of, sort=False))

    def missing(self, as_of: str | dt.date, use_global_start: bool = False) -> list[dt.date]:
        """Fetch the trading days without data, all in one job; gives those days."""
        if self.stored() is None:
            raise FileNotFoundError(f"no table at {self.path}")
        due = missing_dates(self.calendar, self.dates(), as_of, use_global_start)
        days = [r["date"] for r in due.collect()]
        if days:
            wanted = self.spark.createDataFrame([(d,) for d in days], "date date")
            rows = self.fetch_range(days[0], days[-1], sort=False)
            self._write(rows.join(F.broadcast(wanted), "date", "left_semi"))
        return days

    def latest(self, as_of: str | dt.date) -> tuple[dt.date, dt.date] | None:
        """Fetch what came after the last stored day; everything if nothing is stored."""
        existing = self.dates()
        if existing.isEmpty():
            self.full(as_of)
            return GLOBAL_START, as_date(as_of)
        bounds = new_dates(self.calendar, existing, as_of).agg(
            F.min("date").alias("first"), F.max("date").alias("last")
        ).first()
        if bounds["first"] is None:
            return None
        self._write(self.fetch_range(bounds["first"], bounds["last"], sort=False))
        return bounds["first"], bounds["last"]

    def _write(self, rows: DataFrame) -> None:
        write_table(rows, self.config, self.path)
