"""A training corpus from raw documents in five stages; each works on all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns documents again, the last one token ids. Rows keep all
their columns; where a stage changes texts, ``n_chars`` follows. Stages leave the session with Arrow batches of ``BATCH_ROWS`` rows at
most: whole texts travel in them, and a task holds its batches beside the executor's heap. Results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import lines, mixing, neardups, pieces, toxicity
from factorloom.llm.storage import store

TOKENIZER = "piece_bpe_32k.model"
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCHES)) <= BATCH_ROWS:
            spark.conf.set(BATCHES, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the model gives a chance of 0.3 or more of being toxic go; it learns from the labels of the folder."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    return scored.filter(~F.col("__rejected")).select(*docs.columns)


@in_small_batches
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a similar line before them go; every document stays, if need be without lines."""
    found = lines.remove_similar_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(changed))
    return found.select(*docs.columns)


@in_small_batches
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; each text of a repeated id is a document."""
    names = docs.columns
    docs = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__text": F.coalesce(F.sha2("text", 256), F.lit(""))})
    texts = docs.filter("__id is not null").select("__id", "__text")
    unlike = texts.groupBy("__id").agg(F.min("__text").alias("one"), F.max("__text").alias("other"))
    if unlike.filter("one <> other").isEmpty():
        docs = docs.withColumn("__own", F.col("__id"))
    else:
        # numbers of their own for ids and texts, in the order of the ids
        sorted_texts = texts.distinct().repartitionByRange("__id", "__text").sortWithinPartitions("__id", "__text")
        numbers = store(sorted_texts.withColumn("__own", F.monotonically_increasing_id()), "numbers")
        docs = store(docs.join(numbers, ["__id", "__text"], "left"), "numbered")
    found = neardups.near_duplicates(docs.select(F.col("__own").alias("doc_id"), "text"), size=5, percent=80)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("__own") == F.col("__gone"), "left_anti")
    return kept.select(*names).dropDuplicates(["doc_id", "text"])


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


@in_small_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of the text they decode to."""
    model = pieces.read_model(public_tokenizers.path(TOKENIZER))
    return pieces.encode(docs, model, ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "stage")
    return docs


#: The stages learn a model, compare sets and segment texts, which SQL cannot express; tests use brute force.
ORACLE_SQL = None
