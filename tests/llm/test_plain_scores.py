"""Scores of fitted models against a plain rescoring, text by text, on odd cases."""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import quality, toxicity, words

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")

UPPER, LOWER, DIGIT, STOPS, SIGNS = rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[.!?]", rb"[.!?,;:'\"()\-/]"
SYMBOLS, BLANK, WIDE = rb"[#$%&*+<=>@\[\\\]^_`{|}~]", rb"[ \t\v\f\r\n]", rb"[\x80-\xff]"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def both(spark, docs, tables):
    """Supplied documents and the odd corpus, with its nulls, long texts, repeated rows and clashing columns."""
    names = ["doc_id", "text"]
    more = tables[0].select(*names)
    return docs, docs.select(*names).union(more)


def hash_of(word: bytes) -> np.ndarray:
    return words.feature_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), fold=True)


def toxic_score(model, text) -> float:
    numbers = set()
    for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode()):
        forms = [hash_of(word)]
        forms += [words.mixed(hash_of(word[:n]) + np.uint64(n)) for n in (4, 5) if len(word) > n]
        numbers |= {int(f[0]) >> (64 - toxicity.BITS) for f in forms}
    return sum(float(model.weights[n]) for n in sorted(numbers))


def test_severity_is_the_sum_of_the_chances_of_grades(docs, both, tables):
    model = toxicity.train(*tables)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    found = toxicity.score_documents(both[1], model).collect()
    assert len(found) == both[1].count()
    scores = {t: toxic_score(model, t) for t in {r["text"] for r in found}}
    for r in found:
        chances = [1 / (1 + math.exp(t - scores[r["text"]])) for t in model.thresholds]
        assert r["__severity"] == pytest.approx(sum(chances), rel=1e-9, abs=1e-12)
        assert r["__rejected"] == (chances[0] >= 0.3) and r["__grade"] == sum(c >= 0.5 for c in chances)
    assert any(r["__rejected"] for r in found)
    clashing = toxicity.score_documents(docs, model)
    assert clashing.columns == [*docs.columns, "__severity", "__grade", "__rejected"]
    assert clashing.filter("size <> 1 or kept <> 'x'").isEmpty() and clashing.count() == docs.count()


def quality_values(text) -> list[float]:
    raw = (text or "").encode()
    found = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    size, n = len(raw), len(found)

    def count(pattern):
        return len(re.findall(pattern, raw))

    def per(a, b):
        return a / max(b, 1)

    same = Counter(w.lower() for w in found)
    breaks = raw.count(b"\n")
    bare = sum(len(w) == 1 or bool(re.fullmatch(SYMBOLS, w[-1:])) for w in found)
    return [
        np.log1p(float(size)), np.log1p(float(n)), per(size - count(BLANK), n), per(count(UPPER), size),
        per(count(LOWER), size), per(count(DIGIT), size), per(count(SIGNS), size), per(count(SYMBOLS), size),
        per(count(WIDE), size), per(breaks, n), per(len(same), n), per(max(same.values(), default=0), n),
        per(sum(len(w) <= 3 for w in found), n), per(bare, n), per(count(STOPS), n), np.log1p(per(float(size), breaks + 1)),
    ]


def quality_score(model, values) -> float:
    total = model.start
    for value, cuts, table in zip(values, model.cuts, model.tables, strict=True):
        total += table[sum(value >= c for c in cuts)]
    coarse = [sum(v >= c for c in cuts) for v, cuts in zip(values, model.pair_cuts)]
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[coarse[a], coarse[b]]
    return 1 / (1 + math.exp(-total))


def test_quality_is_a_sum_of_table_entries(docs, both, tables):
    model = quality.train(*tables)
    assert model.pairs and any(np.ptp(t) > 0 for t in model.tables)
    found = quality.score_documents(both[1], model).collect()
    texts = [(r["doc_id"], r["text"]) for r in both[1].collect()]
    want = Counter()
    for i, t in texts:
        want[i, round(quality_score(model, quality_values(t)), 9)] += 1
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in found) == want
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    assert quality.score_documents(docs, model).count() == docs.count()
