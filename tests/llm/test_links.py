"""Near duplicates, line dedup, vectors and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import lines, neardups, vectors
from factorloom.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def grouped(items, linked):
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in items}


# ---- 4: near duplicates ----------------------------------------------------------------------


def shingles_of(text, size):
    found = words_of(text)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1)))


@pytest.mark.parametrize(("size", "percent", "short"), [(3, 85, 16), (5, 80, 2)])
def test_near_duplicates_against_brute_force(docs, rows, monkeypatch, size, percent, short):
    monkeypatch.setattr(neardups, "SHORT", short)  # 2: nearly every list is a long one
    monkeypatch.setattr(neardups, "CENTRES", 2)
    with_id = sorted({(i, t) for i, t, *_ in rows if i is not None and i not in (5, 6)}, key=str)
    sets = {i: shingles_of(t, size) for i, t in with_id}
    ids = sorted(sets)
    linked = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = grouped(ids, linked)
    found = neardups.near_duplicates(docs.filter("doc_id is null or doc_id not in (5, 6)"), size, percent).collect()
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            i = row["doc_id"]
            assert (row["n_shingles"], row["component_id"]) == (len(sets[i]), want[i])
            assert row["kept"] == (want[i] == i)
    assert len(found) == len([r for r in rows if r[0] not in (5, 6)])


def test_rows_of_one_id_use_their_own_sets(docs):
    found = neardups.near_duplicates(docs, 3, 85).filter("doc_id in (5, 6)").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (6, 6), (6, 6)]


def test_families_around_one_template(spark, monkeypatch):
    """Unlike texts that share most of a passage, and one family of near copies."""
    monkeypatch.setattr(neardups, "SHORT", 4)
    monkeypatch.setattr(neardups, "CENTRES", 3)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8))):
            text[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(text)))
    sets = {i: shingles_of(t, 3) for i, t in texts}
    linked = [
        (a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = grouped(list(sets), linked)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardups.near_duplicates(frame, 3, 85).collect()}
    assert found == want


def test_near_duplicates_of_nothing(nothing):
    assert neardups.near_duplicates(nothing).collect() == []


# ---- 8: lines --------------------------------------------------------------------------------


def lines_that_go(rows, percent=80):
    every = []
    for i, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            every.append(((2**63 - 1 if i is None else i), n, frozenset(words_of(line))))
    gone = set()
    for i, n, held in every:
        for j, m, other in every:
            if held and other and (j, m) < (i, n) and min(len(held), len(other)) * 100 >= percent * max(
                len(held), len(other)
            ):
                if 100 * len(held & other) >= percent * len(held | other):
                    gone.add((i, n, held))
                    break
    return gone


@pytest.mark.parametrize("nearest", [4, 1])
def test_lines_against_brute_force(spark, rows, monkeypatch, nearest):
    monkeypatch.setattr(lines, "NEAREST", nearest)  # 1: lines stop early and walk again
    rng = random.Random(9)
    base = [f"t{i}" for i in range(12)]
    family = []
    for i in range(40):
        line = list(base)
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(12)] = f"v{rng.randrange(30)}"
        family.append((400 + i, "\n".join([" ".join(line), "", "Short line"]), "en", "s", 1, "k", 1, "x"))
    some = [r for r in rows if r[0] not in (310, 311, 6)] + family
    frame = spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                  "key string, size int, kept string").repartition(3)  # fmt: skip
    want = lines_that_go(some)
    found = lines.remove_similar_lines(frame).collect()
    assert len(found) == len(some)
    texts = {(r[0], r[1]) for r in some}
    for row in found:
        i = 2**63 - 1 if row["doc_id"] is None else row["doc_id"]
        source = [t for d, t in texts if d == row["doc_id"]]
        good = []
        for t in source:
            split = (t or "").split("\n")
            gone = [n for n, line in enumerate(split) if (i, n, frozenset(words_of(line))) in want]
            kept = t if not gone else "\n".join(x for n, x in enumerate(split) if n not in gone)
            good.append((kept, gone, len(split)))
        assert (row["text"], row["__gone"] or [], row["__n_lines"]) in good


def test_lines_of_nothing(nothing):
    assert lines.remove_similar_lines(nothing).collect() == []


# ---- 10: vectors -----------------------------------------------------------------------------


def vector_rows():
    rng = np.random.default_rng(4)
    rows, number = [], 0
    for size in (1,) * 300 + (40, 25, 10, 3, 2):
        centre = rng.normal(size=16)
        for _ in range(size):
            rows.append((number, (centre + 0.05 * rng.normal(size=16)).astype(np.float32).tolist(), 1, "x"))
            number += 1
    rows += [(number + i, rows[i][1], 1, "x") for i in range(5)]  # copies
    number += 5
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [1.0] * 4]
    rows += [(number + i, v, 0, "x") for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], 0, "x"), (0, rows[0][1], 0, "x")]
    return rows


def test_vectors_against_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, kept string").repartition(3)
    found = vectors.link_vectors(frame, leaf_sample=64, sample_rows=200).collect()
    assert len(found) == len(rows)
    good = [(i, np.array(v, float)) for i, v, *_ in rows[:-1] if i is not None and v and len(v) == 16
            and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    want = grouped(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    links = dict(zip(ids, near.sum(1).tolist()))
    # the first vector's second row is one more copy for those near it
    copies = {i: links[i] + int(i == 0 or near[0, n]) for n, i in enumerate(ids)}
    total = 0
    for row in found:
        i = row["vec_id"]
        if i is None or i not in want:
            assert row["n_links"] == 0 and row["component_id"] == i and row["kept"]
            continue
        assert row["n_links"] <= copies[i]
        total += row["n_links"] if i else row["n_links"] / 2
        assert row["component_id"] >= want[i]
        assert row["kept"] == (row["component_id"] == i)
    assert total >= 0.9 * sum(copies.values())


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vectors.link_vectors(empty).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.link_vectors(odd).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


# ---- components ------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    found = dict(map(tuple, connected(frame, "a", "b").collect()))
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}
    assert connected(frame.filter(F.lit(False)), "a", "b").collect() == []
