"""Quality by a generalised additive model with pairwise interactions.

Boosting goes round the features in turn and gives each a shallow tree over its bins; the trees of a
feature add up to one lookup table. Afterwards the pairs of features that explain most of
what is left get tables over two bins. A score is the sum of table entries, so scoring is
looking up bins and adding.

Learning takes at most ``SAMPLE_ROWS`` labelled documents, of which only the feature values reach the driver;
every whole text is scored in its scan. Labels, language, source and id are no inputs.

Cases: a null or empty text has all features 0 and gets a score like any other; without labelled
rows the score is 0.5 everywhere, with one class only it tends to that class; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import words
from factorloom.llm.labelled import held_out, labelled_sample

SAMPLE_ROWS = 50_000
BINS = 32
PAIR_BINS = 12
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "sign", "symbol", "wide", "lines",
    "distinct_words", "top_word", "short_words", "bare_words", "sentence_ends", "line_bytes",
)

_CLASSES = np.zeros(256, np.int64)  # 0: other control characters
for _code, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".!?", b",;:'\"()-/",
     b"#$%&*+<=>@[\\]^_`{|}~", b" \t\v\f\r", b"\n"), 1
):
    _CLASSES[list(_bytes)] = _code
_CLASSES[128:] = 9


def _per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, sizes = len(offsets) - 1, np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n) * 10, sizes) + _CLASSES[data], minlength=10 * n)
    counts = counts[: 10 * n].reshape(n, 10).astype(float)
    starts, ends = words.bounds(data, offsets, words.SPACES)
    owner = words.owners(starts, offsets)
    total = np.bincount(owner, minlength=n).astype(float)
    found = words.feature_hashes(data, starts, ends, fold=True)
    order = np.lexsort((found, owner))
    owner_s, found_s = owner[order], found[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner_s[1:] != owner_s[:-1]) | (found_s[1:] != found_s[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(order)))
    distinct = np.bincount(owner_s[heads], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner_s[heads], runs)
    long = ends - starts
    last = _CLASSES[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    bare = np.bincount(owner[(long <= 1) | (last == 6)], minlength=n)
    short = np.bincount(owner[long <= 3], minlength=n)
    size = sizes.astype(float)
    return np.column_stack([
        np.log1p(size), np.log1p(total), _per(size - counts[:, 7] - counts[:, 8], total), _per(counts[:, 1], size),
        _per(counts[:, 2], size), _per(counts[:, 3], size), _per(counts[:, 4] + counts[:, 5], size),
        _per(counts[:, 6], size), _per(counts[:, 9], size), _per(counts[:, 8], total), _per(distinct, total),
        _per(top, total), _per(short, total), _per(bare, total), _per(counts[:, 4], total),
        np.log1p(_per(size, counts[:, 8] + 1)),
    ])


def features(column: pa.Array) -> np.ndarray:
    parts = [_block_features(data, offsets) for _, _, data, offsets in words.blocks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, values: np.ndarray) -> np.ndarray:
        found = np.full(len(values), self.start)
        for i, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            found += table[np.searchsorted(cuts, values[:, i], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, values[:, i], "right") for i, c in enumerate(self.pair_cuts)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                found += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(found, -35, 35)))


def _cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


RIDGE = 5.0


def _leaf(g: np.ndarray, h: np.ndarray):
    return g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g * _leaf(left_g, left_h) + right_g * _leaf(right_g, right_h) - g.sum() * _leaf(g.sum(), h.sum())
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree over ordered bins with at most ``leaves`` leaves, as the value of each bin."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        gain, at, run = max(((*_split(g[a:b], h[a:b]), (a, b)) for a, b in runs), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        a, b = run
        runs.remove(run)
        runs += [(a, a + at), (a + at, b)]
    found = np.zeros(len(g))
    for a, b in runs:
        found[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return found


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of a tree that cuts one axis and then the other on both sides."""
    best_gain, best = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, gg.shape[0]):
            table, total = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                a, b = gg[part].sum(axis=0), hh[part].sum(axis=0)
                gain, at = _split(a, b)
                at = at if gain > 1e-9 else len(a)
                for side in (slice(0, at), slice(at, None)):
                    value = _leaf(a[side].sum(), b[side].sum())
                    total += a[side].sum() * value
                    table[part, side] = value
            if total > best_gain:
                best_gain, best = total, table if axis == 0 else table.T
    return best_gain, best


def fit(
    values: np.ndarray, labels: np.ndarray, rounds: int = 150, pair_rounds: int = 20, pairs: int = 8, rate: float = 0.1
) -> AdditiveModel:
    """Cyclic boosting of the log-odds: single features first, then the best pairs."""
    width = values.shape[1]
    if not len(labels):
        return AdditiveModel(0.0, [np.zeros(0)] * width, [np.zeros(1)] * width)
    share = np.clip(labels.mean(), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    cuts = [_cut_points(values[:, i], BINS) for i in range(width)]
    bins = [np.searchsorted(c, values[:, i], "right") for i, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    scores = np.full(len(labels), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-scores))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for i in range(width):
            g, h = slopes()
            size = len(tables[i])
            tree = rate * _tree(np.bincount(bins[i], g, size), np.bincount(bins[i], h, size))
            tables[i] += tree
            scores += tree[bins[i]]
    model = AdditiveModel(start, cuts, tables)
    model.pair_cuts = [_cut_points(values[:, i], PAIR_BINS) for i in range(width)]
    coarse = [np.searchsorted(c, values[:, i], "right") for i, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grid(a: int, b: int, what: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], what, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = {(a, b): _pair_tree(grid(a, b, g), grid(a, b, h))[0] for a in range(width) for b in range(a)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            tree = rate * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            model.pair_tables[k] += tree
            scores += tree[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """A model of ``labels.quality`` from at most ``rows`` documents that are not held out."""
    sample = labelled_sample(docs, labels, "quality", rows, ~held_out(F.col("doc_id")))

    def values_of(batches):
        for batch in batches:
            parts = [row.tobytes() for row in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), words.packed(parts)], ["label", "features"]
            )

    found = sample.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(
        values_of, "label int, features binary"
    )
    table = found.toArrow().sort_by([("features", "ascending"), ("label", "ascending")])
    values = np.frombuffer(b"".join(table["features"].to_pylist())).reshape(-1, len(FEATURES))
    return fit(values, np.asarray(table["label"].to_pylist(), dtype=float))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(features(column)), pa.float64())

    rows = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
