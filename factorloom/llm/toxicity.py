"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's features are the hashed words and beginnings of words it holds. One weight vector is shared by all
thresholds: P(grade >= k) = sigmoid(score - threshold_k), with ordered thresholds. The expected severity is the
sum of these probabilities, from 0 to the highest grade.

The model is fitted on a bounded sample of labelled documents (``SAMPLE_ROWS``), of which only
feature numbers reach the driver; scoring reads every whole text in its scan.
The supplied labels know two grades. ``severity_grades`` parts the toxic ones: above the median
share of words that mark toxic documents, the grade is 2. Any number of grades can be given instead.

Cases: a null or empty text has the score 0 and falls to the grade of the thresholds alone; repeated words
count once; without labelled rows, or with one grade only, nothing can be learned and the severity is 0
everywhere; an empty table of documents gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import words
from factorloom.llm.labelled import labelled_sample

SAMPLE_ROWS = 20_000
BITS = 19
BLOCK = 1 << 19
BEGINNINGS = (4, 5)  # bytes of a word that count as a feature too, so forms of a word share weights
REJECT = 0.3  # chance of any grade above 0 from which a document goes
LEAST_RATIO = 10.0


@dataclass(frozen=True)
class SeverityModel:
    weights: np.ndarray  # by hashed word
    thresholds: np.ndarray  # ascending

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -700, 700)))

    def severity(self, scores: np.ndarray) -> np.ndarray:
        return self.at_least(scores).sum(axis=1)


def feature_blocks(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of rows of each block; row in the block and number of each distinct hashed word, and word beginning of some bytes, by row.

    Features take many times the memory of their text, so no more than a block's are there at once.
    """
    for first, last, data, offsets in words.blocks(column, BLOCK):
        starts, ends = words.bounds(data, offsets, words.SIGNS)
        owner = words.owners(starts, offsets)
        found, of = [words.feature_hashes(data, starts, ends, fold=True)], [owner]
        for size in BEGINNINGS:
            longer = ends - starts > size
            head = words.feature_hashes(data, starts[longer], starts[longer] + size, fold=True)
            found.append(words.mixed(head + np.uint64(size)))
            of.append(owner[longer])
        key = np.concatenate(of).astype(np.uint64) << np.uint64(bits)
        pairs = np.unique(key | (np.concatenate(found) >> np.uint64(64 - bits)))
        yield last - first, (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64(2**bits - 1)).astype(np.int64)


def severity_grades(rows: np.ndarray, numbers: np.ndarray, toxic: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Grades 0, 1, 2 from toxic 0/1: toxic documents above the median share of marking words are 2."""
    size = 2**bits
    of_toxic = np.bincount(numbers[toxic[rows] > 0], minlength=size)
    of_clean = np.bincount(numbers[toxic[rows] == 0], minlength=size)
    many, few = max(1, int((toxic > 0).sum())), max(1, int((toxic == 0).sum()))
    marking = (of_toxic >= 5) & (of_toxic / many > 10 * (of_clean + 0.5) / few)
    held = np.bincount(rows[marking[numbers]], minlength=len(toxic))
    share = held / np.maximum(1, np.bincount(rows, minlength=len(toxic)))
    median = np.median(share[toxic > 0]) if (toxic > 0).any() else 0.0
    return np.where(toxic == 0, 0, np.where(share > median, 2, 1))


def telling(rows: np.ndarray, numbers: np.ndarray, grades: np.ndarray, least: float, bits: int) -> np.ndarray:
    """Features whose presence depends on the grade being above 0: likelihood ratio of at least ``least``."""
    size, above = 2**bits, grades > 0
    n, m = len(grades), int(above.sum())
    held = np.bincount(numbers, minlength=size).astype(float)
    both = np.bincount(numbers[above[rows]], minlength=size).astype(float)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    ratio = 2 * (
        part(both, held * m / n) + part(held - both, held * (n - m) / n)
        + part(m - both, (n - held) * m / n) + part(n - m - held + both, (n - held) * (n - m) / n)
    )
    return (ratio >= least) & (held >= 3)


def fit(
    rows: np.ndarray,
    numbers: np.ndarray,
    grades: np.ndarray,
    bits: int = BITS,
    steps: int = 200,
    rate: float = 0.1,
    penalty: float = 1e-4,
    least: float = LEAST_RATIO,
) -> SeverityModel:
    """Maximum likelihood with a quadratic penalty, by Adam on all rows, over the telling features.

    Thresholds are learned as the first one and positive gaps, which keeps them ordered.
    """
    top = int(grades.max()) if len(grades) else 0
    if top < 1 or not (grades == 0).any():
        return SeverityModel(np.zeros(2**bits, np.float32), np.array([700.0]))
    chosen = telling(rows, numbers, grades, least, bits)[numbers]
    rows, numbers = rows[chosen], numbers[chosen]
    kept, place = np.unique(numbers, return_inverse=True)
    n = len(grades)
    weights = np.zeros(len(kept))
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    starts = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(starts), 1e-2))
    params = [weights, starts[:1].copy(), gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    last, own = np.clip(grades, 0, top), np.arange(n)
    for step in range(1, steps + 1):
        thresholds = np.concatenate([params[1], params[1] + np.cumsum(np.exp(params[2]))])
        scores = np.bincount(rows, weights=params[0][place], minlength=n)
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -35, 35)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        chance = np.maximum(edges[own, last] - edges[own, last + 1], 1e-12)
        slope = edges * (1 - edges)
        d_score = -(slope[own, last] - slope[own, last + 1]) / chance / n
        d_threshold = np.zeros(top)
        for k in range(1, top + 1):
            sign = (last == k).astype(float) - (last == k - 1)
            d_threshold[k - 1] = (sign * slope[:, k] / chance).sum() / n
        found = [
            np.bincount(place, weights=d_score[rows], minlength=len(kept)) + penalty * params[0],
            np.array([d_threshold.sum()]),
            np.cumsum(d_threshold[::-1])[::-1][1:] * np.exp(params[2]),
        ]
        for p, g, (m, v) in zip(params, found, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    dense = np.zeros(2**bits, np.float32)
    dense[kept] = params[0]
    return SeverityModel(dense, np.concatenate([params[1], params[1] + np.cumsum(np.exp(params[2]))]))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, learn=None) -> SeverityModel:
    """A model from ``labels.toxic`` of at most ``rows`` documents."""
    sample = labelled_sample(docs, labels, "toxic", rows, learn)

    def numbers_of(batches):
        for batch in batches:
            parts = []
            for count, owner, numbers in feature_blocks(batch.column("text")):
                ends = np.searchsorted(owner, np.arange(count + 1))
                parts += [numbers[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), words.packed(parts)], ["label", "numbers"]
            )

    found = sample.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(
        numbers_of, "label int, numbers binary"
    )
    table = found.toArrow().sort_by([("numbers", "ascending"), ("label", "ascending")])
    raw = table["numbers"].to_pylist()
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) // 4 for x in raw])
    numbers = np.frombuffer(b"".join(raw), "<i4")
    toxic = np.asarray(table["label"].to_pylist(), dtype=np.int64)
    del table, raw
    return fit(owner, numbers, severity_grades(owner, numbers, toxic))


def raw_scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each text's features."""
    blocks = feature_blocks(column)
    scores = [np.bincount(rows, weights=weights[numbers], minlength=count) for count, rows, numbers in blocks]
    return np.concatenate([np.zeros(0), *scores])


def severity_column(docs: DataFrame, model: SeverityModel, text: str = "text"):
    """The raw score of a text column; the weights (a fixed size) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(raw_scores(column, shared.value))

    return score(F.col(text))


def score_documents(docs: DataFrame, model: SeverityModel, reject: float = REJECT) -> DataFrame:
    """``docs`` with __severity (expected grade), __grade (most thresholds likely passed), __rejected."""
    score = severity_column(docs, model)
    chances = [1 / (1 + F.exp(F.lit(float(t)) - F.col("__score"))) for t in model.thresholds]
    scored = docs.withColumn("__score", score)
    grade = sum((F.when(c >= 0.5, 1).otherwise(0) for c in chances[1:]), F.when(chances[0] >= 0.5, 1).otherwise(0))
    return scored.withColumns(
        {"__severity": sum(chances[1:], chances[0]), "__grade": grade, "__rejected": chances[0] >= reject}
    ).drop("__score")
