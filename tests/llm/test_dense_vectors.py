"""Leaves that hold many vectors: split further or compared block by block, in bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np

from factorloom.llm import vectors


def near(centre, n, noise, rng):
    return centre + noise * rng.normal(size=(n, len(centre)))


def test_a_dense_leaf_is_compared_block_by_block(spark, monkeypatch):
    """A third of the rows are unequal near copies; the others are spread."""
    rng = np.random.default_rng(8)
    rows = np.concatenate([near(rng.normal(size=16), 300, 0.01, rng), rng.normal(size=(600, 16))])
    frame = spark.createDataFrame([(8 * i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    splits = []
    plain = vectors._split_large

    def noted(*given):
        splits.append(plain(*given))
        return splits[-1]

    monkeypatch.setattr(vectors, "_split_large", noted)
    monkeypatch.setattr(vectors, "LEAF_ROWS", 64)
    found = {r["vec_id"] // 8: r for r in vectors.link_vectors(frame.repartition(3), leaf_sample=1000).collect()}
    routed, solid = splits[0]
    numbers = [x for r in routed.select("leaves").collect() for x in np.frombuffer(r["leaves"], np.int64)]
    sizes = dict(zip(*np.unique(numbers, return_counts=True)))
    assert solid and all(n <= 64 or solid[leaf] == n for leaf, n in sizes.items())
    assert len({x // vectors.TREE for x in numbers}) == vectors.TREES and len(sizes) > 2 * vectors.TREES
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert all(found[i]["n_links"] == linked[i].sum() and found[i]["component_id"] == 0 for i in range(300))
    assert all(found[i]["n_links"] <= linked[i].sum() for i in found)


def test_pairs_of_a_dense_leaf_are_not_kept():
    rng = np.random.default_rng(2)
    n = 6000
    rows = vectors._unit(near(rng.normal(size=8), n, 0.001, rng))
    leaves = np.zeros((n, 1, 1), np.int64)
    tracemalloc.start()
    counted, roots = vectors._compare(rows, np.ones(n), leaves, 0, 0.9)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (counted == n - 1).all() and (roots == 0).all()
    assert most < 150e6  # all 18 million pairs would take 288 MB and more


def test_two_blocks_meet_only_each_other():
    rng = np.random.default_rng(3)
    rows = vectors._unit(near(rng.normal(size=8), 30, 0.001, rng))
    counted, roots = vectors._compare(rows, np.ones(30), np.zeros((30, 1, 1), np.int64), 0, 0.9, cut=10)
    assert counted.tolist() == [20] * 10 + [10] * 20 and (roots == 0).all()


def test_a_row_near_many_cuts_reaches_all_their_leaves():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(512, 8))
    tree = vectors.grow(sample, 1, 8, 0.9)
    numbers, own = tree.leaves(sample)
    assert len(set(zip(numbers.tolist(), own.tolist()))) == len(own) and set(own) == set(range(512))
    assert np.bincount(own).max() > 4
    for row in (0, 100, 500):  # by following both sides one node after the other
        open_nodes, want = [0], set()
        while open_nodes:
            node = open_nodes.pop()
            if node < 0:
                want.add(-1 - node)
                continue
            away = sample[row] @ tree.directions[node] - tree.cuts[node]
            side = int(away > 0)
            open_nodes.append(tree.children[node, side])
            if abs(away) <= tree.margins[node]:
                open_nodes.append(tree.children[node, 1 - side])
        assert want == set(numbers[own == row].tolist())


def test_vectors_of_each_length_link_among_themselves(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0]) for i in range(5)] + [(10, [1.0, 0.0]), (11, [1.0, 0.1]), (12, [0.0, 1.0])]
    rows += [(20, [3.0]), (21, [3.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.link_vectors(frame).collect()}
    want = {i: (4, 0, i == 0) for i in range(5)}
    want |= {10: (1, 10, True), 11: (1, 10, False), 12: (0, 12, True), 20: (1, 20, True), 21: (1, 20, False)}
    assert found == want
