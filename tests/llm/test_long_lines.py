"""Long lines: parities that keep unlike ones apart, and sets read from the chosen lines only."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from factorloom.llm import lines, words
from factorloom.llm.packing import batch as packed_batch
from tests.llm.test_links import lines_that_go, words_of


def met_of(texts):
    data, offsets = words.buffers(pa.array(texts, pa.string()))
    ids = np.arange(len(texts))
    rows = lines._entries(data, offsets, ids, ids * 11, np.zeros(2**lines.COUNT_BITS, np.int64), 1, 80)
    return lines._meet(80)(pa.Table.from_batches([packed_batch(rows, lines.ENTRIES)])).to_pylist()


def test_unlike_long_lines_make_no_pairs():
    rng = random.Random(2)
    sizes = (90, 150, 200, 300, 500, 900)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(5000)], n)) for n in sizes for _ in range(40)]
    assert [r for r in met_of(texts) if r["kind"] == lines.PAIR] == []


def changed(rng, text, share):
    return " ".join(f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_parities_never_rule_out_a_similar_line():
    rng = random.Random(5)
    texts, want = [], set()
    for n in (60, 80, 81, 100, 160, 161, 330, 700, 1500):
        base = " ".join(f"b{n}x{i}" for i in range(n))
        texts += [base, *(changed(rng, base, rng.choice([0.04, 0.1, 0.13])) for _ in range(3))]
    sets = [set(words_of(t)) for t in texts]
    for i, a in enumerate(sets):
        want |= {(i, j) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 80 * len(a | b)}
    found = {(r["doc_id"], r["other_id"]): r["apart"] for r in met_of(texts) if r["kind"] == lines.PAIR}
    assert want and want <= set(found)
    for i, j in found:
        assert found[i, j] * (len(sets[i]) + len(sets[j])) <= len(sets[i] ^ sets[j])


def test_long_lines_against_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.sample([f"w{i}" for i in range(3000)], n)) for n in (70, 120, 250, 400)]
    rows = []
    for i in range(60):
        some = [changed(rng, rng.choice(base), rng.choice([0, 0.03, 0.08, 0.12, 0.3])) for _ in range(2)]
        rows.append((i, "\n".join([*some, "", f"one {i % 9}"])))
    want = lines_that_go(rows)
    found = lines.remove_similar_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    texts = {(i, t): [n for n, x in enumerate(t.split("\n")) if (i, n, frozenset(words_of(x))) in want] for i, t in rows}
    kept = sorted((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g), g) for (i, t), g in texts.items())
    assert sorted((r["doc_id"], r["text"], r["__gone"] or []) for r in found.collect()) == kept


def test_words_with_the_same_first_bits_are_ordered_by_the_whole_hash():
    few = np.array([5, 3, 5, 9, 3], np.uint64) + (np.uint64(1) << np.uint64(60))
    line, found = lines._rarest_first(np.zeros(5, np.int64), few, np.zeros(2**lines.COUNT_BITS, np.int64))
    assert line.tolist() == [0, 0, 0] and found.tolist() == sorted(set(few.tolist()))


def test_sets_are_read_from_chosen_lines_only():
    texts = ["a b\n\nc d e", None, "", "x y\nx y z"]
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": [1, 2, 3, 4], "key": [-7, 8, 9, 10], "text": [t or "" for t in texts]}
    )
    bits = np.zeros(2**lines.FILTER_BITS >> 3, np.uint8)
    for i, k, n in ((1, -7, 2), (4, 10, 0)):
        at = int(lines._filter_places(np.array([i]), np.array([k]), np.array([n]))[0])
        bits[at >> 3] |= 1 << (at & 7)

    class Shared:
        value = bits

    found = [r for b in lines._token_sets(Shared)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["key"], r["line"], len(r["tokens"]) // 8) for r in found] == [(1, -7, 2, 3), (4, 10, 0, 2)]
