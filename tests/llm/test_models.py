"""Classifiers on held-out rows, the registered queries, and the pipeline."""

from __future__ import annotations

import os

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import queries, quality, toxicity
from factorloom.llm.labelled import held_out, labelled_sample
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels, learn=~out)
    scored = toxicity.score_documents(docs, model).filter(out).join(labels, "doc_id")
    row = scored.agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("__rejected").cast("int"))).alias("caught"),
        F.avg(F.when(F.col("toxic") == 0, F.col("__rejected").cast("int"))).alias("wrong"),
        F.avg(F.when(F.col("toxic") == 1, F.col("__severity"))).alias("high"),
        F.avg(F.when(F.col("toxic") == 0, F.col("__severity"))).alias("low"),
    ).first()
    assert row["caught"] > 0.75 and row["wrong"] < 0.01 and row["high"] > row["low"] + 0.5


def test_ordered_thresholds_share_weights():
    rng = np.random.default_rng(0)
    n, grades = 600, rng.integers(0, 4, 600)
    # a document holds more of the words 0..9 the higher its grade, and others at random
    rows = np.concatenate([np.full(g * 2 + 5, i) for i, g in enumerate(grades)])
    numbers = np.concatenate([np.r_[rng.permutation(10)[: g * 2], rng.integers(10, 200, 5)] for g in grades])
    model = toxicity.fit(rows, numbers, grades, bits=8)
    scores = np.bincount(rows, weights=model.weights[numbers], minlength=n)
    severity = model.severity(scores)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    means = [severity[grades == g].mean() for g in range(4)]
    assert np.all(np.diff(means) > 0.5) and np.abs(severity - grades).mean() < 0.5


def test_models_without_labels(docs, nothing, no_labels):
    model = toxicity.train(docs, no_labels)
    scored = toxicity.score_documents(docs, model)
    assert scored.filter("__rejected or __severity > 0.001").isEmpty() and scored.count() == docs.count()
    assert toxicity.score_documents(nothing, model).collect() == []
    plain = quality.train(docs, no_labels)
    found = quality.score_documents(docs, plain).collect()
    assert len(found) == docs.count() and {r["score"] for r in found} == {0.5}
    assert quality.score_documents(nothing, plain).collect() == []


def test_quality_of_held_out_documents(tables):
    docs, labels = tables
    scored = quality.score_documents(docs, quality.train(docs, labels))
    assert scored.count() == docs.count()
    row = scored.filter("held_out").join(labels, "doc_id").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"),
        F.avg(F.when(F.col("quality") == 0, (F.col("predicted") == 0).cast("int"))).alias("low"),
    ).first()
    assert row["right"] > 0.95 and row["low"] > 0.8


def test_interactions_are_learned():
    rng = np.random.default_rng(2)
    values = rng.uniform(size=(4000, 3))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    model = quality.fit(values, labels, rounds=20, pair_rounds=60, pairs=1)
    assert ((model.score(values) > 0.5) == labels).mean() > 0.95 and set(model.pairs[0]) == {0, 1}


def test_sample_is_bounded_and_repeatable(tables):
    docs, labels = tables
    one, two = (
        {r["doc_id"] for r in labelled_sample(d, labels, "toxic", 50).collect()}
        for d in (docs, docs.repartition(7))
    )
    assert one == two and len(one) == 50


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.SQL[name]) is None


def test_pipeline_stages(spark):
    """Each stage gives documents again; what is rejected, repeated or mixed shows in the next one."""
    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, SMALL), "stage")
        seen.append((name, docs))
    for _, table in seen[:-1]:
        assert table.schema.simpleString() == first.schema.simpleString()
    toxic, lines, near, mixed, coded = (t for _, t in seen)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert toxic.count() < first.count()
    assert first.join(toxic, "doc_id", "left_anti").join(labels.filter("toxic = 0"), "doc_id").count() <= 1
    assert lines.count() == toxic.count()
    assert lines.filter("n_chars <> length(text)").isEmpty()
    assert lines.agg(F.sum("n_chars")).first()[0] < toxic.agg(F.sum("n_chars")).first()[0]
    assert near.count() <= lines.count() and coded.count() == mixed.count()


def test_pipeline_drops_copies(spark, docs):
    found = corpus_pipeline.dedup_near(spark, docs, "")
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert not {100 + i for i in range(12)} & set(ids) and 0 in ids and found.columns == docs.columns


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
