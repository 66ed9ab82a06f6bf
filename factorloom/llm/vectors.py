"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits a bounded sample recursively by random directions at the median, until a
leaf holds few sample rows. All rows then go down every tree; one that lies close to a
split goes down both sides (spill), so near pairs are seldom parted. Rows of a leaf are
compared with each other by one matrix product in double precision.

A pair may meet in several leaves. Rows carry the leaves they reach in all trees, and a pair counts
only in the first tree (and there the first leaf) where it meets. So the numbers of links of the leaves simply add up, and no
table of pairs is written: a leaf returns, for each of its rows, the number of links it is to count and
the smallest row it is connected with inside the leaf. Components follow from these few links.

Leaves with more than LEAF_ROWS rows are split further by random directions; there the margin is the length a
pair at the threshold has along a random direction. Where the rows lie too close together for that, the leaf is
compared block against block, one task for each pair of blocks. A task folds the pairs of each matrix product into counts
and roots, so its memory depends on LEAF_ROWS alone.

Equal vectors are one class with a multiplicity, so thousands of copies cost one row.

Cases: vectors that are null, empty, zero, or that hold null or non-finite numbers link with nothing;
vectors link only with others of their length; repeated vec_ids of equal vectors are returned once per
row; null vec_ids are returned, never linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.components import connected
from factorloom.session import materialize

SAMPLE_ROWS = 20_000
LEAF_SAMPLE = 128  # rows of the sample in a leaf
TREES = 8
SPILL = 0.15  # share of a node's rows, around the median, that go down both sides
LEAF_ROWS = 8_192  # a larger leaf is split further, or compared block by block
MOST_SHARE = 0.8  # of a leaf's rows that may go down one side of a further split
BLOCK = 1_024  # rows on each side of one matrix product
TREE = 2**40  # leaf numbers of a tree start at its own multiple


@dataclass
class Tree:
    """Inner nodes in one array; a child below 0 is the leaf ``-1 - child``."""

    directions: np.ndarray
    cuts: np.ndarray
    margins: np.ndarray
    children: np.ndarray

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All leaves the rows reach, and the row of each."""
        at, own = np.zeros(len(rows), np.int64), np.arange(len(rows))
        if not len(self.cuts):
            return at, own
        leaves, reached = [], []
        while len(own):
            away = np.einsum("ij,ij->i", rows[own], self.directions[at]) - self.cuts[at]
            side = (away > 0).astype(np.int64)
            near = np.abs(away) <= self.margins[at]
            at = np.concatenate([self.children[at, side], self.children[at[near], 1 - side[near]]])
            own = np.concatenate([own, own[near]])
            done = at < 0
            leaves.append(-1 - at[done])
            reached.append(own[done])
            at, own = at[~done], own[~done]
        return np.concatenate([*leaves, at]), np.concatenate([*reached, own])


def grow(sample: np.ndarray, seed: int, leaf: int = LEAF_SAMPLE, spill: float = SPILL) -> Tree:
    """A tree over the sample: random directions, cut at the median."""
    random = np.random.default_rng(seed)
    directions, cuts, margins, children = [], [], [], []
    leaves = 0
    open_nodes = [(np.arange(len(sample)), None, 0)]
    while open_nodes:
        rows, parent, side = open_nodes.pop()
        # a direction between two rows of the node follows its spread
        direction = None
        if len(rows) > leaf:
            direction = random.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            away = sample[rows] @ direction
            cut = float(np.median(away))
            low = away <= cut
            if low.all() or not low.any():
                direction = None
        if direction is None:
            if parent is not None:
                children[parent][side] = -1 - leaves
            leaves += 1
            continue
        if parent is not None:
            children[parent][side] = len(cuts)
        margin = np.quantile(np.abs(away - cut), spill)
        directions.append(direction)
        cuts.append(cut)
        margins.append(float(margin))
        children.append([0, 0])
        me = len(cuts) - 1
        open_nodes += [(rows[low], me, 0), (rows[~low], me, 1)]
    width = sample.shape[1]
    return Tree(
        np.array(directions).reshape(-1, width), np.array(cuts), np.array(margins), np.array(children).reshape(-1, 2)
    )


def _unit(rows: np.ndarray) -> np.ndarray:
    # the largest number first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if pa.types.is_binary(column.type):
        raw = b"".join(column.to_pylist())
        return np.frombuffer(raw, np.float64).reshape(-1, width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _join(parent: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest row connected with each row, after more links."""
    apart = parent[one] != parent[other]
    one, other = one[apart], other[apart]
    while True:
        a, b = parent[one], parent[other]
        low = np.minimum(a, b)
        before = parent.copy()
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        if np.array_equal(before, parent):
            return parent


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers of all rows one after the other, and the row of each."""
    raw = column.to_pylist()
    own = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
    return np.frombuffer(b"".join(raw), np.int64), own


def _packed(numbers: np.ndarray, own: np.ndarray, n: int) -> pa.Array:
    """The leaf numbers of each row as one binary value; what _ragged takes apart."""
    order = np.lexsort((numbers, own))
    ends = np.searchsorted(own[order], np.arange(1, n))
    return pa.array([x.tobytes() for x in np.split(numbers[order].astype(np.int64), ends)], pa.binary())


def _by_tree(numbers: np.ndarray, own: np.ndarray, n: int, trees: int) -> np.ndarray:
    """(row, tree, place): the leaf numbers, filled up with -1."""
    key = own * trees + numbers // TREE
    order = np.argsort(key, kind="stable")
    key, numbers = key[order], numbers[order]
    place = np.arange(len(key)) - np.searchsorted(key, key, "left")
    found = np.full((n * trees, int(place.max(initial=0)) + 1), -1, np.int64)
    found[key, place] = numbers
    return found.reshape(n, trees, -1)


def _meet_first(leaves: np.ndarray, a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether pairs that meet in this leaf meet in no earlier tree, and in no smaller leaf of this one."""
    first = np.ones(len(a), bool)
    many = (leaves >= 0).sum(2)
    for t in range(leaf // TREE + 1):
        for i in range(leaves.shape[2]):
            live = np.flatnonzero(first & (many[a, t] > i))
            if not len(live):
                break
            for j in range(leaves.shape[2]):
                live = live[many[b[live], t] > j]
                if not len(live):
                    break
                mine = leaves[a[live], t, i]
                same = (mine == leaves[b[live], t, j]) & (mine < leaf)
                first[live[same]] = False
                live = live[~same]
    return first


def _compare(rows, copies, leaves, leaf: int, threshold: float, cut: int = 0):
    """Links counted here for each row, and the root of each row's component inside the leaf.

    With a ``cut`` only rows before it are compared with rows from there on.
    """
    n = len(rows)
    counted = np.zeros(n, np.int64)
    roots = np.arange(n)
    for i in range(0, cut or n, BLOCK):
        above = rows[i : min(i + BLOCK, cut or n)]
        for j in range(cut or i, n, BLOCK):
            a, b = np.nonzero(above @ rows[j : j + BLOCK].T >= threshold)
            a, b = a + i, b + j
            keep = a < b
            a, b = a[keep], b[keep]
            roots = _join(roots, a, b)
            own = _meet_first(leaves, a, b, leaf)
            a, b = a[own], b[own]
            counted += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
    return counted, roots


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct good vector: smallest vec_id, its copies, the vector as doubles."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    good = vectors.select("vec_id", numbers.alias("v")).filter(F.col("vec_id").isNotNull())
    good = good.filter(F.size("v") > 0).filter(
        ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    good = good.filter(F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one value
    plain = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return plain.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))


FOUND = "vec_id bigint, counted bigint, root bigint"
ROUTED = "vec_id bigint, copies bigint, row binary, leaves binary"
NOTHING = pa.table({n: pa.array([], pa.int64()) for n in ("vec_id", "counted", "root")})
MIX = np.uint64(0x9E3779B97F4A7C15)  # so that ids at even steps fill all blocks
DEALT = 10_000  # rows of a batch that go to leaves at once
SHARES = [i / 20 for i in range(1, 20)]


def _split_large(routed: DataFrame, width: int, threshold: float) -> tuple[DataFrame, dict[int, int]]:
    """Splits leaves above LEAF_ROWS until none is left but those too dense to split; these with their rows.

    A round takes one aggregate for the rows of the leaves and one for the places of the cuts; only
    numbers of large leaves come to the driver.
    """
    spark = routed.sparkSession
    margin = float(np.sqrt(max(2 - 2 * threshold, 0) / width))
    solid: dict[int, int] = {}
    fresh = 2**32  # above the numbers of any first leaf

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ragged(batch.column("leaves"))[0])], ["leaf"])

    while True:
        counts = routed.select("leaves").mapInArrow(places, "leaf bigint").groupBy("leaf").count()
        large = {r["leaf"]: r["count"] for r in counts.filter(F.col("count") > LEAF_ROWS).collect()}
        solid = {leaf: n for leaf, n in large.items() if leaf in solid}
        large = {leaf: n for leaf, n in large.items() if leaf not in solid}
        if not large:
            return routed, solid
        chosen = np.array(sorted(large), np.int64)

        def ways(chosen=chosen):
            directions = np.stack([np.random.default_rng(int(x)).normal(size=width) for x in chosen])
            return directions / np.linalg.norm(directions, axis=1, keepdims=True)

        def along(batch, directions, chosen=chosen):
            """Leaf numbers of a batch and their rows; of the places in chosen leaves also how far along they lie."""
            numbers, own = _ragged(batch.column("leaves"))
            at = np.minimum(np.searchsorted(chosen, numbers), len(chosen) - 1)
            hit = chosen[at] == numbers
            rows = _matrix(batch.column("row"), width)
            return numbers, own, at, hit, np.einsum("ij,ij->i", rows[own[hit]], directions[at[hit]])

        def measure(batches, along=along, ways=ways):
            directions = ways()
            for batch in batches:
                numbers, _, _, hit, away = along(batch, directions)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[hit]), pa.array(away)], ["leaf", "away"])

        cuts = routed.select("row", "leaves").mapInArrow(measure, "leaf bigint, away double")
        cuts = cuts.groupBy("leaf").agg(F.percentile_approx("away", SHARES, 1_000).alias("at")).collect()
        middle = {}
        for row in cuts:
            cut = row["at"][len(SHARES) // 2]
            low, high = np.interp([cut - margin, cut + margin], row["at"], SHARES, 0, 1)
            if max(high, 1 - low) <= MOST_SHARE:
                middle[row["leaf"]] = cut
            else:
                solid[row["leaf"]] = large[row["leaf"]]
        if not middle:
            return routed, solid
        cut = np.array([middle.get(x, np.nan) for x in chosen.tolist()])
        first = np.arange(len(chosen), dtype=np.int64) * 2 + fresh + chosen // TREE * TREE
        fresh += 2 * len(chosen)

        def split(batches, along=along, ways=ways, cut=cut, first=first):
            directions = ways()
            for batch in batches:
                numbers, own, at, hit, away = along(batch, directions)
                spot = np.flatnonzero(hit)
                mine = cut[at[spot]]
                going = ~np.isnan(mine)
                spot, away, mine = spot[going], away[going], mine[going]
                low, high = away <= mine + margin, away > mine - margin
                stays = np.ones(len(numbers), bool)
                stays[spot] = False
                child = first[at[spot]]
                numbers = np.concatenate([numbers[stays], child[low], child[high] + 1])
                own = np.concatenate([own[stays], own[spot][low], own[spot][high]])
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(["vec_id", "copies", "row"]).columns, _packed(numbers, own, batch.num_rows)],
                    ["vec_id", "copies", "row", "leaves"],
                )

        routed = materialize(routed.mapInArrow(split, ROUTED), "split")


def _links_among(
    classes: DataFrame,
    width: int,
    threshold: float,
    trees: int,
    sample_rows: int,
    leaf_sample: int,
    spill: float,
    seed: int,
) -> DataFrame:
    """(vec_id, counted, root): links of vectors of one length, counted once, and the row each is connected with."""
    spark = classes.sparkSession
    chosen = classes.orderBy(F.xxhash64("vec_id")).limit(sample_rows).select("v").toArrow()
    sample = _unit(_matrix(chosen["v"].combine_chunks(), width))
    forest = spark.sparkContext.broadcast(
        [grow(sample, seed + t, leaf_sample, spill) for t in range(trees)]
    )

    def route(batches):
        for batch in batches:
            rows = _unit(_matrix(batch.column("v"), width))
            reached = [t.leaves(rows) for t in forest.value]
            numbers = np.concatenate([x + t * TREE for t, (x, _) in enumerate(reached)])
            leaves = _packed(numbers, np.concatenate([own for _, own in reached]), len(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("copies"),
                    pa.array([x.tobytes() for x in rows], pa.binary()),
                    leaves,
                ],
                ["vec_id", "copies", "row", "leaves"],
            )

    routed = materialize(classes.mapInArrow(route, ROUTED), "routed")
    routed, solid = _split_large(routed, width, threshold)
    blocks = spark.sparkContext.broadcast({leaf: -(-n // LEAF_ROWS) for leaf, n in solid.items()})

    def deal(batches):
        """Each row to its leaves; in a leaf of many blocks, to its block's comparison with each of them."""
        for batch in batches:
            numbers, own = _ragged(batch.column("leaves"))
            many = np.array([blocks.value.get(x, 1) for x in numbers.tolist()], np.int64)
            mixed = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.uint64) * MIX >> np.uint64(32)
            mine = mixed.astype(np.int64)[own] % many
            start = np.repeat(np.cumsum(many) - many, many)
            other = np.arange(len(start)) - start
            leaf, mine, take = np.repeat(numbers, many), np.repeat(mine, many), np.repeat(own, many)
            for i in range(0, len(take), DEALT):
                at = slice(i, i + DEALT)
                some = batch.take(pa.array(take[at]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaf[at]),
                        pa.array(np.minimum(mine[at], other[at])),
                        pa.array(np.maximum(mine[at], other[at])),
                        pa.array(mine[at] > other[at]),
                        *some.columns,
                    ],
                    ["leaf", "one", "two", "second", *some.schema.names],
                )

    dealt = routed.mapInArrow(deal, f"leaf bigint, one bigint, two bigint, second boolean, {ROUTED}")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("second", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        ids = table["vec_id"].to_numpy()
        rows = _matrix(table["row"].combine_chunks(), width)
        leaves = _by_tree(*_ragged(table["leaves"].combine_chunks()), len(ids), trees)
        copies = table["copies"].to_numpy().astype(float)
        cut = 0
        if table["one"][0].as_py() != table["two"][0].as_py():
            cut = len(ids) - sum(table["second"].to_pylist())
            if cut in (0, len(ids)):
                return NOTHING
        counted, roots = _compare(rows, copies, leaves, table["leaf"][0].as_py(), threshold, cut)
        linked = np.flatnonzero((counted > 0) | (roots != np.arange(len(ids))))
        return pa.table(
            {"vec_id": ids[linked], "counted": counted[linked], "root": ids[roots[linked]]}
        )

    return dealt.groupBy("leaf", "one", "two").applyInArrow(compare, FOUND)


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    leaf_sample: int = LEAF_SAMPLE,
    spill: float = SPILL,
    seed: int = 7,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    classes = materialize(_classes(vectors), "classes")
    sizes = classes.groupBy(F.size("v").alias("width")).count().orderBy("width").collect()
    result = vectors.select("vec_id", _fingerprint("embedding").alias("__f"))
    if not sizes:
        return result.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    # vectors of each length are linked among themselves; a lone one with its copies only
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for size in sizes:
        if size["count"] > 1:
            alike = classes.filter(F.size("v") == size["width"])
            met = _links_among(alike, size["width"], threshold, trees, sample_rows, leaf_sample, spill, seed)
            found = found.union(materialize(met, "met"))
    parts = connected(found, "vec_id", "root")
    links = found.groupBy("vec_id").agg(F.sum("counted").alias("__links"))
    classes = (
        classes.select("vec_id", "copies", _fingerprint("v").alias("__g"))
        .join(links, "vec_id", "left")
        .join(parts.withColumnRenamed("item", "vec_id"), "vec_id", "left")
        .select(
            "__g",
            (F.coalesce("__links", F.lit(0)) + F.col("copies") - 1).alias("__n"),
            F.coalesce("component", "vec_id").alias("__c"),
        )
    )
    result = result.join(classes, (F.col("__f") == F.col("__g")) & F.col("vec_id").isNotNull(), "left")
    return result.select(
        "vec_id",
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("__c", "vec_id").alias("component_id"),
        (F.coalesce("__c", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"),
    )


def _fingerprint(column: str):
    """Equal for equal vectors only; its text form keeps every digit of a double."""
    numbers = F.transform(column, lambda x: x.cast("double") + F.lit(0.0))
    return F.sha2(F.to_json(numbers).cast("binary"), 256)
