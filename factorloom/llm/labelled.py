"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Column | None = None
) -> DataFrame:
    """Texts of at most ``rows`` labelled documents: doc_id, text, label.

    The rows with the smallest hash of their id are taken, so the sample does not depend on how
    the tables are laid out. Rows with a null id or label are left out; a document with
    several labels has its largest. The chosen ids are bounded by ``rows``, so they are broadcast.
    """
    chosen = labels.select("doc_id", F.col(label).alias("label")).dropna()
    if learn is not None:
        chosen = chosen.filter(learn)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
