"""Session set-up and the shared scratch folder for written intermediate tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cpus: int | str = "*", app: str = "factorloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.sql.adaptive.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def setting(spark: SparkSession, name: str, default: int) -> int:
    """A size limit, from the session's ``spark.factorloom.<name>`` if set."""
    return int(spark.conf.get(f"spark.factorloom.{name}", str(default)))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary folder only in local mode."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="factorloom-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/factorloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with ``options`` of the writer, and read it back.

    Cuts the lineage and fixes values such as partition numbers, so a lost executor
    re-reads files and never recomputes them differently.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_for(spark: SparkSession, rows: int, task_rows: int) -> Iterator[None]:
    """Jobs started inside shuffle to at least ``rows / task_rows`` partitions, so a task's share does not follow the input."""
    before = spark.conf.get(SHUFFLE_PARTITIONS)
    spark.conf.set(SHUFFLE_PARTITIONS, str(max(int(before), math.ceil(rows / task_rows))))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, before)


@contextmanager
def arrow_batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send Arrow batches of at most so many rows: for tables whose rows are large."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
