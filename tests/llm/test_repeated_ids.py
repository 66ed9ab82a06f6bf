"""Near-dedup of the pipeline when an id stands for unlike texts."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.conftest import CLASHING, DOCS, sentence


def test_the_other_text_of_an_id_stays(spark):
    rng = random.Random(1)
    first, clean, last = (sentence(rng, 60) for _ in range(3))
    texts = [
        (3, first), (6, first + " more"), (6, clean), (6, clean), (7, clean + " too"), (8, last), (9, None), (9, last + " end"),
        (None, first), (2, "short"), (2, ""),
    ]
    rows = [(i, t, "en", "s", len(t or ""), *CLASHING) for i, t in texts]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    found = corpus_pipeline.dedup_near(spark, frame, "")
    assert found.columns == frame.columns
    want = [(3, first), (6, clean), (8, last), (9, None), (None, first), (2, "short"), (2, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted(want, key=str)
