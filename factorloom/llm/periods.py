"""Runs of words: stretches that repeat with a period, found by uniting suffixes in descending order.

Words become numbers, and the texts of a block one sequence in which no two texts share a number. Ranks of all
stretches of 1, 2, 4, ... words, each made from two ranks of the level before, order the suffixes and give
the longest common prefix (LCP) of neighbours. Pairs of neighbours are then taken by decreasing LCP, as in
Kruskal's algorithm: a union-find keeps the classes of suffixes that share so many words, each with its
positions in order, and the smaller class is merged into the larger. Two positions that become
neighbours in a class at LCP ``l`` and lie ``q <= l`` apart begin a stretch of ``q + l`` words with period ``q``. For
the first position of a run with four periods or more, its second period is such a neighbour exactly at the run's own LCP:
a position between them would give a smaller period. So runs come out with their smallest period, each once.

A run here has at least ``LEAST`` words and ``TIMES`` periods, so LCPs below ``LEAST - 1`` are never united, and texts
without a repeated stretch of four words are done after three levels. Texts are handled in blocks of a few
megabytes; a longer text is a block of its own, and its arrays follow its words.

Cases: a null or empty text has no words; repeated rows are handled one by one; equal words are equal bytes; other columns are
carried along by name, whatever the name. A null key plants nothing.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.carried import map_texts
from factorloom.llm.splitting import byte_blocks, word_lists

LEAST = 6
TIMES = 4
LOWEST = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST))

Run = tuple[int, int, int]


class Numbers(dict):
    """Words and their numbers in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def planted(ids: np.ndarray, h: int | None) -> np.ndarray:
    """The words of a text, of one in ten with a periodic tail; ``h`` is a hash of its key."""
    n = len(ids)
    if h is None or h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def levels_of(ids: np.ndarray, most: int | None = None) -> list[np.ndarray]:
    """Dense ranks of the stretches of 1, 2, 4, ... numbers at each place, until all differ; a stretch can pass the end."""
    found = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    while len(found) != most and int(found[-1].max(initial=-1)) + 1 < len(ids):
        ranks, reach = found[-1].astype(np.int64), 1 << (len(found) - 1)
        after = np.zeros_like(ranks)
        after[: max(len(ids) - reach, 0)] = ranks[reach:] + 1
        found.append(np.unique(ranks * (len(ids) + 1) + after, return_inverse=True)[1].astype(np.int32))
    return found


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """LCP of each suffix in order with the next one."""
    one, two = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    found = np.zeros(len(one), np.int64)
    last = len(order) - 1
    for step in range(len(levels) - 1, -1, -1):
        ranks = levels[step]
        a, b = one + found, two + found
        inside = (a <= last) & (b <= last)
        same = ranks[np.minimum(a, last)] == ranks[np.minimum(b, last)]
        found += np.where(inside & same, 1 << step, 0)
    return found


def seeds(pairs: Iterator[tuple[int, int, int]], times: int = TIMES, least: int = LEAST) -> Iterator[Run]:
    """(start, length, period) of stretches that newly neighbouring positions begin; pairs come by decreasing LCP."""
    parent: dict[int, int] = {}
    classes: dict[int, list[int]] = {}
    for lcp, a, b in pairs:
        for x in (a, b):
            if x not in parent:
                parent[x], classes[x] = x, [x]
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        large, small = classes[a], classes.pop(b)
        parent[b] = a
        if lcp < LOWEST:
            continue
        before = None
        for i, x in enumerate(small):
            at = bisect(large, x)
            left = large[at - 1] if at else None
            right = large[at] if at < len(large) else None
            large.insert(at, x)
            # a neighbour from the same class was one before; one that the next of ``small`` parts is none
            if left is not None and left != before and _long(x - left, lcp, times, least):
                yield left, x - left + lcp, x - left
            later = small[i + 1] if i + 1 < len(small) else None
            if right is not None and (later is None or later > right) and _long(right - x, lcp, times, least):
                yield x, right - x + lcp, right - x
            before = x


def _long(period: int, lcp: int, times: int, least: int) -> bool:
    return period * (times - 1) <= lcp and period + lcp >= least


def runs_of(texts: Sequence[np.ndarray]) -> list[list[Run]]:
    """The runs of each text, by start and period; a text is an array of word numbers."""
    found: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if not len(texts) or ends[-1] == len(texts):
        return found
    # texts are set apart by a number of their own, and equal words of different texts by their text
    owner = np.repeat(np.arange(len(texts)), sizes)
    words_ = np.concatenate([np.append(t, -1) for t in texts]).astype(np.int64)
    width = int(words_.max()) + 2
    ids = owner * width + words_ + 1
    if len(texts) > 1:
        short = levels_of(ids, 3)[-1]
        repeated = np.unique(owner[np.bincount(short)[short] > 1])
        if len(repeated) < len(texts):
            for i, own in zip(repeated.tolist(), runs_of([texts[i] for i in repeated])):
                found[i] = own
            return found
    levels = levels_of(ids)
    order = np.argsort(levels[-1])
    lcps = common_prefixes(levels, order)
    del levels
    kept = np.flatnonzero(lcps >= LOWEST)
    kept = kept[np.argsort(-lcps[kept], kind="stable")]
    starts = (ends - sizes).tolist()
    pairs = zip(lcps[kept].tolist(), order[kept].tolist(), order[kept + 1].tolist())
    for start, length, period in seeds(pairs):
        text = int(owner[start])
        # only the leftmost of a stretch's places begins the run
        if start == starts[text] or ids[start - 1] != ids[start - 1 + period]:
            found[text].append((start - starts[text], length, period))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(n: int, runs: Sequence[Run]) -> np.ndarray:
    """Whether each word stays when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run with the most periods; of equal ones the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = "struct<start: bigint, length: bigint, period: bigint>"
_FIELDS = [pa.field(n, pa.int64()) for n in ("start", "length", "period")]


def _structs(runs: Sequence[Run | None]) -> pa.Array:
    columns = [pa.array([r and r[i] for r in runs], pa.int64()) for i in range(3)]
    return pa.StructArray.from_arrays(columns, fields=_FIELDS, mask=pa.array([r is None for r in runs], pa.bool_()))


def _block(texts: Sequence[bytes], plants: Sequence[int | None]) -> list[pa.Array]:
    numbers = Numbers()
    number = numbers.__getitem__
    ids = []
    for raw, h in zip(texts, plants):
        parts = [np.fromiter(map(number, found), np.int64, len(found)) for found in word_lists(raw)]
        ids.append(planted(np.concatenate(parts) if parts else np.zeros(0, np.int64), h))
    found = runs_of(ids)
    names = list(numbers)
    collapsed = []
    for own, runs in zip(ids, found):
        left = own[kept_words(len(own), runs)] if runs else own
        collapsed.append(b" ".join([names[i] for i in left.tolist()]))
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])])
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _structs([r for runs in found for r in runs]))
    return [
        pa.array([len(x) for x in ids], pa.int64()), listed, _structs([strongest(r) for r in found]),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]


def _make():
    def run(batch: pa.RecordBatch) -> Iterator[tuple[int, list[pa.Array]]]:
        plants, first = batch.column("plant").to_pylist(), 0
        for texts in byte_blocks(batch.column("text")):
            yield len(texts), _block(texts, plants[first : first + len(texts)])
            first += len(texts)

    return run


def find_runs(docs: DataFrame, carry: Sequence[str] = ("doc_id",), plant: Column | None = None) -> DataFrame:
    """The ``carry`` columns with ``n_words``, ``runs`` (by start and period), ``strongest`` and the ``collapsed`` text.

    ``plant`` is a hash by which one text in ten gets a periodic tail before runs are sought.
    """
    inputs = {"text": F.col("text"), "plant": (F.lit(None) if plant is None else plant).cast("bigint")}
    outputs = {"n_words": "bigint", "runs": f"array<{RUN}>", "strongest": RUN, "collapsed": "string"}
    return map_texts(docs, carry, inputs, _make, outputs)
