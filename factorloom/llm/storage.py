"""Written intermediate tables whose shuffle files go when the table is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factorloom.session import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Nothing refers to the shuffles behind it any more, so their files need not wait for the driver's
    garbage collection.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(CLEANUP, before)
