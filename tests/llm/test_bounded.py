"""What a task holds or makes: small blocks, links in place of pairs, lists kept once."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from factorloom.llm import lines, neardups, pieces, shingles, words
from factorloom.llm.packing import batch as packed_batch
from tests.llm.conftest import sentence
from tests.llm.test_links import grouped, shingles_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_made_in_small_blocks():
    rng = random.Random(1)
    texts = [sentence(rng, 900) for _ in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"__c0": list(range(len(texts))), "__text": texts})
    model = pieces.read_model(PATH)
    found = list(pieces._encoder(model, 1, True)(iter([batch])))
    held = [sum(len(texts[i] or "") for i in part.column("__c0").to_pylist()) for part in found]
    assert sum(held) > 1 << 20 and max(held) <= 1 << 18
    library = pieces.load(model)
    ids = [x for part in found for x in part.column("__ids").to_pylist()]
    assert ids == [library.encode(t or "") for t in texts]


def test_sketches_are_made_in_small_blocks():
    batch = pa.RecordBatch.from_pydict({"doc_id": range(400), "text": ["word " * 2000] * 400})
    parts = list(neardups._few(batch))
    assert sum(len(p) for p in parts) == 400
    assert max(len(p) for p in parts) * 10_000 <= 1 << 19


def family(seed: int, count: int) -> list[tuple[int, str]]:
    """Copies of one text with more or fewer changes, most of them around the threshold."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for i in range(count):
        text = list(base)
        for _ in range(rng.choice((1, 2, 2, 3, 3, 4))):
            text[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(text)))
    return texts


def linked_by_force(texts):
    sets = {i: shingles_of(t, 3) for i, t in texts}
    return [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]


def test_a_list_gives_a_forest_of_links():
    texts = family(2, 80)
    values = [v.tobytes() for v in shingles.shingle_sets(pa.array([t for _, t in texts]), 3)]
    ids, n = [i for i, _ in texts], [len(v) // 8 for v in values]
    both = len(ids) * 2
    table = pa.table({
        "key": pa.array([1] * both), "piece": pa.array([0] * both), "id": pa.array(ids * 2), "n": pa.array(n * 2),
        "u": pa.array([0] * both), "part": pa.array(ids * 2), "family": pa.nulls(both, pa.int64()),
        "allowed": pa.nulls(both, pa.list_(pa.int64())), "values": pa.array(values * 2),
        "centre": pa.array([False] * len(ids) + [True] * len(ids)),
    })
    found = neardups._forest(85)(table)
    pairs = list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    want = linked_by_force(texts)
    assert len(want) > 2 * len(ids) > 2 * len(pairs)
    assert grouped(ids, pairs) == grouped(ids, want)
    # what is one component already needs no link; a large family that is not allowed is not met
    one = table.set_column(table.column_names.index("part"), "part", pa.array([7] * both))
    assert neardups._forest(85)(one).num_rows == 0
    other = table.set_column(table.column_names.index("family"), "family", pa.array([5] * both))
    assert neardups._forest(85)(other).num_rows == 0


def test_long_lists_are_dealt_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(neardups, "SHORT", 2)
    monkeypatch.setattr(neardups, "CENTRES", 3)
    monkeypatch.setattr(neardups, "PIECE", 700)
    rng = random.Random(8)
    texts = family(4, 40)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [(100 + i, f"{passage} {sentence(rng, rng.randint(2, 14))}") for i in range(40)]
    want = grouped([i for i, _ in texts], linked_by_force(texts))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = neardups.near_duplicates(frame, 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want


@pytest.mark.parametrize("nearest", [1, 2])
def test_lists_of_stopped_lines_are_kept(monkeypatch, nearest):
    monkeypatch.setattr(lines, "NEAREST", nearest)
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        line = [f"t{i}" for i in range(12)]
        line[rng.randrange(12)] = f"y{rng.randrange(30)}"
        texts.append(" ".join(line))
    data, offsets = words.buffers(pa.array(texts))
    ids = np.arange(len(texts))
    rows = lines._entries(data, offsets, ids, ids * 11, np.zeros(2**lines.COUNT_BITS, np.int64), 1, 80)
    table = pa.Table.from_batches([packed_batch(rows, lines.ENTRIES)])
    met = lines._meet(80)(table).to_pylist()
    stopped = {(r["token"], r["doc_id"], r["key"], r["line"]) for r in met if r["kind"] == lines.OPEN}
    held = {r["token"]: r["held"] for r in met if r["kind"] == lines.LIST}
    assert stopped and {t for t, *_ in stopped} == set(held)
    wanted = [[{"doc_id": d, "key": k, "line": n} for t, d, k, n in stopped if t == token] for token in held]
    batch = pa.RecordBatch.from_pydict({"r": [0] * len(held), "held": list(held.values()), "wanted": wanted})
    names = [x for x in (f.split()[0] for f in lines.MET.split(", ")) if x not in ("kind", "r", "token", "held")]
    again = [tuple(x[n] for n in names) for b in lines._walk_held(80)(iter([batch])) for x in b.to_pylist()]
    lists = lines._Lists(table, 80)
    at = [i for i in range(len(lists.token)) if (int(lists.token[i]), int(lists.ids[lists.docs[i]]),
          int(lists.keys[lists.docs[i]]), int(lists.line[i])) in stopped]
    one, other, _ = lists.walk(np.array(at), None)
    assert sorted(again) == sorted(tuple(x[n] for n in names) for x in lists.rows(lines.PAIR, 0, one, other).to_pylist())
    assert len(again) > len(stopped)
