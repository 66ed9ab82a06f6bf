"""What tasks hold at once follows a block of texts, not the batch."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from factorloom.llm import toxicity


def test_scores_hold_the_features_of_one_block():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(400)) for _ in range(2_000)] + [None, ""]
    weights = np.random.default_rng(3).random(2**toxicity.BITS).astype(np.float32)
    column = pa.array(texts, pa.string())
    alone = [toxicity.raw_scores(pa.array([t], pa.string()), weights)[0] for t in texts[::100]]
    tracemalloc.start()
    found = toxicity.raw_scores(column, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and found[-2:].tolist() == [0, 0]
    assert found[::100].tolist() == alone
    # the features of all 4.5 MB take 50 MB and more
    assert peak < 25e6


def test_stages_send_texts_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", 3)], "doc_id bigint, text string, source string, lang string, n_chars int")
    spark.conf.set(corpus_pipeline.BATCHES, "10000")
    try:
        for given, left in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(corpus_pipeline.BATCHES, given)
            assert corpus_pipeline.mix_sources(spark, docs, "").count() >= 1
            assert spark.conf.get(corpus_pipeline.BATCHES) == left
    finally:
        spark.conf.unset(corpus_pipeline.BATCHES)
