"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (
    fingerprints,
    lines,
    middles,
    mixing,
    neardups,
    periods,
    pieces,
    quality,
    secrets,
    suffixes,
    token_counts,
    toxicity,
    vectors,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def encode_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(documents(spark, folder), model, ["doc_id"])


def score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels(spark, folder)))
    names = ("severity", "grade", "rejected")
    return scored.select("doc_id", *[F.col(f"__{n}").alias(n) for n in names])


def score_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return quality.score_documents(docs, quality.train(docs, labels(spark, folder)))


def remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, folder))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardups.near_duplicates(documents(spark, folder), size=3, percent=85)


def find_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, folder))


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder).select("doc_id", "text", "source"))


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, folder))


def dedup_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.remove_similar_lines(documents(spark, folder).select("doc_id", "text"))
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    return found.select(
        "doc_id",
        F.col("__n_lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        gone.alias("removed_lines"),
    )


def link_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.link_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = middles.fill_in_middle(documents(spark, folder))
    back = middles.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def find_runs(spark: SparkSession, folder: str) -> DataFrame:
    plant = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periods.find_runs(documents(spark, folder), plant=plant)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = {n: F.col(f"strongest.{n}") for n in ("start", "length", "period")}
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[c.alias(n) for n, c in top.items()],
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        found = token_counts.count_tokens(documents(spark, folder), file.read())
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES: dict[str, Query] = {
    "op1_encode_pieces": encode_pieces,
    "op2_remove_repeats": remove_repeats,
    "op3_score_toxicity": score_toxicity,
    "op4_near_duplicates": near_duplicates,
    "op5_find_secrets": find_secrets,
    "op6_score_quality": score_quality,
    "op7_mix_sources": mix_sources,
    "op8_dedup_lines": dedup_lines,
    "op9_fingerprint": fingerprint,
    "op10_link_embeddings": link_embeddings,
    "op11_fill_in_middle": fill_in_middle,
    "op12_find_runs": find_runs,
    "op13_count_tokens": count_tokens,
}

SQL: dict[str, str] = {
    "op5_find_secrets": secrets.sql(),
    "op7_mix_sources": mixing.sql(),
    "op11_fill_in_middle": middles.sql(),
}
