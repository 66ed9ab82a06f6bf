"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's sketch holds its ``K`` smallest shingle hashes. Documents with equal sets are one
class, found by a fingerprint of the whole set. For the others, inverted lists are kept for
runs of three neighbouring sketch values: of two sets with a Jaccard similarity J, each value of the union's
sketch is shared with chance J, and a run of three shared ones is a run in both sketches. A pair at 0.85 without a
common run among its first ``KEYED`` values has a chance below 1e-9 (at 0.8, below 1e-7); when the sets are no larger than
that, such a run exists for certain (at most a fifth of the values differ, so some three in a row do not; in
sets of up to ``SMALL`` values, two). Similarities below 0.8 are refused.
Runs make lists far shorter than single values: a common line alone no longer brings documents together.

Members of a list are compared in full while it is short. In a longer list, some members (the centres) are
compared with all others; centres have then met everyone and leave. Lists whose members are all
connected already are done, which ends a list of thousands of near copies after one round; only members outside a
list's largest component have to be centres. For documents of lists
still open after that (unlike ones around a common passage), lists are made anew from whole sets: of the
shingles in order of rarity, the first 15 % and one more must hold a shared one, and a rare shingle has few owners. A
document meets a large family there only if all the family's shingles together cover enough of it. Centres and
members meet there by their full sets inside a task (a list is dealt out in pieces of about ``PIECE`` shingles), which
gives back a forest of the links it finds: no row is made for a pair. The
rounds go on until no list is left, so no pair is lost.

Pairs pass the estimate from the union's sketch, then the full sets decide. Each document is first
checked against its most promising partner; other pairs only matter while they are not connected.

Cases: a null or blank text has an empty set, links with nothing and is its own component;
fewer words than a shingle make one; a null doc_id is never linked; rows of one doc_id are
compared by their own sets; repeated rows get the same result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm import shingles, words
from factorloom.llm.components import connected
from factorloom.llm.storage import store

BLOCK = 1 << 19  # bytes of text a task takes at a time
K = 64
KEYED = 48
RUN = 3
SMALL = 6  # values of a set whose runs of two count too
LONGEST = 3  # lists of a document that the first round of centres walks
CENTRES = 2048  # members of a long list that meet all others in one round
PIECE = 1 << 20  # shingles of a long list's members that one task compares with its centres
SHORT = 16  # members of a list that are all compared with each other
LEAST_SHARED = 0.58  # of the union's sketch: six standard deviations below 0.85


def _few(batch: pa.RecordBatch):
    """Parts of a batch with a block of text each, so that what a task holds follows the block."""
    for first, last, *_ in words.blocks(batch.column("text"), BLOCK):
        yield batch.slice(first, last - first)


def sketch_documents(docs: DataFrame, size: int, k: int = K) -> DataFrame:
    """doc_id, n (set size), print (of the whole set), sketch (sorted)."""

    def run(batches):
        for batch in batches:
            for part in _few(batch):
                ns, prints, sketches = [], [], []
                for values in shingles.shingle_sets(part.column("text"), size):
                    ns.append(len(values))
                    prints.append(shingles.set_fingerprint(values))
                    sketches.append(values[:k].astype(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ns, pa.int64()), words.packed(prints), lists],
                    ["doc_id", "n", "print", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, print binary, sketch array<bigint>")


def _run_keys(values: Column) -> Column:
    """Hashes of runs of neighbouring values; in sets of up to SMALL values, runs of two as well."""

    def runs(length: int, most: int) -> Column:
        starts = F.sequence(F.lit(1), F.least(F.size(values), F.lit(most)) - (length - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(values, i, length)))
        return F.when(F.size(values) >= length, hashes).otherwise(F.array().cast("array<bigint>"))

    few = F.when(F.size(values) <= SMALL, runs(RUN - 1, SMALL)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(runs(RUN, KEYED), few)


def _full_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(id, values): whole shingle sets of the needed documents."""

    def run(batches):
        for batch in batches:
            for part in _few(batch):
                sets = [v.tobytes() for v in shingles.shingle_sets(part.column("text"), size)]
                prints = [shingles.set_fingerprint(np.frombuffer(v, np.uint64)) for v in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), words.packed(prints), words.packed(sets)], ["id", "print", "values"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(needed.select("id").distinct(), "id")
    found = texts.mapInArrow(run, "id bigint, print binary, values binary")
    # an id may stand for several texts; its class is told by the fingerprint
    return found.join(needed, ["id", "print"], "left_semi").dropDuplicates(["id", "print"]).drop("print")


def _may_be_similar(percent: int) -> Column:
    """Whether sets of ``n_a`` and ``n_b`` shingles, ``u_a`` and ``u_b`` of them nobody else's, can be similar."""
    common = F.least(F.col("n_a") - F.col("u_a"), F.col("n_b") - F.col("u_b"))
    union = F.greatest(F.col("n_a") + F.col("u_b"), F.col("n_b") + F.col("u_a"))
    return common * 100 >= union * percent


def _pairs_of_short(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of the members of lists with at most SHORT of them."""
    lists = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n", "u"))).alias("m"))
    one = lists.select("m", F.posexplode("m").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("m", F.col("i") + 2, SHORT)).alias("b"))
    names = {"id": "{}", "n": "n_{}", "u": "u_{}"}
    pairs = two.select(*[F.col(f"{x}.{c}").alias(n.format(x)) for x in "ab" for c, n in names.items()])
    return pairs.filter(_may_be_similar(percent)).select("a", "b").filter("a <> b").distinct()


def _centres(members: DataFrame, centres: int) -> DataFrame:
    """(key, c, n_a, u_a): one of each of ``centres`` salts of each list.

    Only members outside the list's largest component need to meet the others.
    """
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(centres))
    chosen = members.filter("outside").groupBy("key", salt.alias("salt")).agg(F.min(F.struct("id", "n", "u")).alias("c"))
    chosen = chosen.select("key", F.col("c.id").alias("c"), F.col("c.n").alias("n_a"), F.col("c.u").alias("u_a"))
    return store(chosen, "centres")


def _stars(members: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Pairs of each list's centres with its members."""
    others = members.select("key", "id", F.col("n").alias("n_b"), F.col("u").alias("u_b"))
    pairs = others.join(chosen, "key").filter(F.col("id") != F.col("c")).filter(_may_be_similar(percent))
    return pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _forest(percent: int):
    """Links between the centres and the members of a piece of a list, one for each two components that meet."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_centre = table["centre"].to_numpy()
        ids, n, u = (table[c].to_numpy() for c in ("id", "n", "u"))
        family = table["family"].fill_null(-1).to_numpy()
        no_family = table["family"].is_null().to_numpy()
        raw = table["values"].to_pylist()
        sizes = np.array([len(x) // 8 for x in raw], np.int64)
        ends = np.cumsum(sizes)
        codes = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)[1]
        _, part = np.unique(table["part"].to_numpy(), return_inverse=True)
        members = np.flatnonzero(~is_centre)
        held = codes[np.repeat(~is_centre, sizes)]
        starts = np.cumsum(sizes[members]) - sizes[members]
        marked = np.zeros(int(codes.max(initial=-1)) + 1, bool)
        ones, others = [], []
        for c in np.flatnonzero(is_centre).tolist():
            common = np.minimum(n[c] - u[c], n[members] - u[members])
            union = np.maximum(n[c] + u[members], n[members] + u[c])
            meet = (part[members] != part[c]) & (common * 100 >= union * percent)
            meet &= no_family[members] | np.isin(family[members], table["allowed"][c].as_py() or [])
            if not meet.any():
                continue
            own = codes[ends[c] - sizes[c] : ends[c]]
            marked[own] = True
            common = np.add.reduceat(marked[held], starts, dtype=np.int64)
            marked[own] = False
            alike = members[meet & (common * 100 >= percent * (sizes[c] + sizes[members] - common))]
            for other in alike[np.unique(part[alike], return_index=True)[1]].tolist():
                ones.append(ids[c])
                others.append(ids[other])
            part[np.isin(part, part[alike])] = part[c]
        return pa.table({"a": pa.array(ones, pa.int64()), "b": pa.array(others, pa.int64())})

    return run


def _met(members: DataFrame, chosen: DataFrame, sets: DataFrame, allowed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect each list's centres with what is similar to them; ``members`` have part and tokens.

    A centre meets members of a large family (``family``) only if the family's shingles cover enough of it.
    """
    pieces = F.ceil(F.col("tokens") / PIECE)
    lists = members.select("key", pieces.alias("pieces")).distinct()
    names = ["key", "piece", "id", "n", "u", "part"]
    dealt = members.withColumn("piece", F.pmod(F.xxhash64("id", "key"), pieces))
    dealt = dealt.select(*names, "family", F.lit(None).cast("array<bigint>").alias("allowed"), F.lit(False).alias("centre"))
    families = allowed.groupBy("id").agg(F.collect_set("family").alias("allowed"))
    centres = chosen.select("key", F.col("c").alias("id"), F.col("n_a").alias("n"), F.col("u_a").alias("u"))
    centres = centres.join(members.select("key", "id", "part").distinct(), ["key", "id"]).join(lists, "key")
    centres = centres.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    centres = centres.join(families, "id", "left")
    centres = centres.select(*names, F.lit(None).cast("bigint").alias("family"), "allowed", F.lit(True).alias("centre"))
    rows = dealt.unionByName(centres).join(sets, "id")
    return rows.groupBy("key", "piece").applyInArrow(_forest(percent), "a bigint, b bigint").distinct()


def _covered(values: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """(id, family): documents of which a large family's shingles, all together, cover ``percent``.

    No member of another family can be similar to the document. A family that covers so much holds one of the
    document's first ``n - ceil(n * percent / 100) + 1`` shingles, in the order of how many other families hold them;
    only families met there are counted in full, so what all families share makes no row for each of them.
    """
    own = owners.select("id", F.col("family").alias("mine"))
    union = values.join(owners.filter("family is not null").select("id", "family"), "id")
    union = store(union.select("family", "key").distinct(), "unions")
    held = union.groupBy("key").agg(F.count(F.lit(1)).alias("families"))
    rows = values.join(own, "id").join(held, "key")
    others = F.col("families") - F.col("mine").isNotNull().cast("long")
    rows = rows.withColumn("size", others).filter("size > 0").select("id", "n", "mine", "key", "size")
    first = _first(rows, values, percent).select("id", "n", "mine", "key")
    met = first.join(union, "key").filter(~F.col("mine").eqNullSafe(F.col("family"))).select("id", "n", "family")
    met = store(met.distinct(), "met_families")
    shared = met.join(values, ["id", "n"]).join(union, ["family", "key"])
    shared = shared.groupBy("id", "n", "family").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") * 100 >= F.col("n") * percent).select("id", "family")


def _promising(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose sketches allow the similarity, with the shared part of the union's sketch."""
    one = classes.select(F.col("id").alias("a"), F.col("sketch").alias("s_a"))
    two = classes.select(F.col("id").alias("b"), F.col("sketch").alias("s_b"))
    rows = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)
    rows = rows.withColumn("u", union)
    shared = F.size(F.array_intersect("u", F.array_intersect("s_a", "s_b")))
    rows = rows.select("a", "b", shared.alias("shared"), F.size("u").alias("of"))
    exact = F.col("shared") * 100 >= F.col("of") * percent
    near = F.col("shared") >= F.col("of") * (LEAST_SHARED * percent / 85)
    return rows.filter(F.when(F.col("of") < k, exact).otherwise(near))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have ``100 * common >= percent * union``."""

    @F.arrow_udf("boolean")
    def alike(one: pa.Array, other: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(one.to_pylist(), other.to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            found.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.array(found, pa.bool_())

    one = sets.select(F.col("id").alias("a"), F.col("values").alias("v_a"))
    two = sets.select(F.col("id").alias("b"), F.col("values").alias("v_b"))
    return pairs.join(one, "a").join(two, "b").filter(alike(F.col("v_a"), F.col("v_b"))).select("a", "b")


def _first(rows: DataFrame, values: DataFrame, percent: int) -> DataFrame:
    """Those of ``rows`` among the first ``n - ceil(n * percent / 100) + 1`` shingles of their document by ``size``.

    The document's shingles in ``values`` that ``rows`` lacks come before them; ``before`` counts them. Where an
    id holds several sets of shingles, all of them count.
    """
    own = Window.partitionBy("id", "n")
    all_of = values.groupBy("id", "n").agg(F.count(F.lit(1)).alias("all"))
    rows = rows.withColumns({"place": F.row_number().over(own.orderBy("size", "key")), "there": F.count("key").over(own)})
    rows = rows.join(all_of, ["id", "n"]).withColumn("before", F.col("all") - F.col("there"))
    length = F.col("all") - F.ceil(F.col("n") * percent / 100) + 1
    return rows.filter(F.col("place") + F.col("before") <= length).drop("place", "there", "all")


def _rare_lists(left: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists (key, id, n, u, size) of the rarest shingles of the documents in ``left``, and all their shingles.

    Similar sets share a shingle among the first ``n - ceil(n * percent / 100) + 1`` of each, in any common
    order. Shingles of one document only come first; they are left out before any join, but counted: ``u``. A member that
    could not be similar to the smallest and least peculiar set of its list leaves the list.
    """

    def run(batches):
        for batch in batches:
            raw = batch.column("values").to_pylist()
            counts = [len(x) // 8 for x in raw]
            own = pa.array(np.repeat(np.arange(len(raw)), counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(own), batch.column("n").take(own),
                 pa.array(np.frombuffer(b"".join(raw), np.int64))],
                ["id", "n", "key"],
            )

    wanted = sets.join(left.select("id", "n").distinct(), "id").select("id", "n", "values")
    values = store(wanted.mapInArrow(run, "id bigint, n bigint, key bigint"), "values")
    owners = values.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    first = _first(values.join(owners, "key"), values, percent)
    lists = store(first.select("key", "id", "n", F.col("before").alias("u")), "rare")
    best = lists.groupBy("key").agg(F.min("n").alias("n_b"), F.min("u").alias("u_b"))
    fit = lists.withColumnsRenamed({"n": "n_a", "u": "u_a"}).join(best, "key")
    union = F.greatest(F.col("n_a") + F.col("u_b"), F.col("n_b") + F.col("u_a"))
    fit = fit.filter((F.col("n_a") - F.col("u_a")) * 100 >= union * percent)
    lists = fit.select("key", "id", F.col("n_a").alias("n"), F.col("u_a").alias("u"))
    return _sized(lists), values


def _sized(lists: DataFrame) -> DataFrame:
    """Lists of two members or more, with their size."""
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return store(lists.join(sizes, "key"), "lists")


class _Links:
    """Links found so far and their components."""

    def __init__(self, spark):
        self.links = spark.createDataFrame([], "a bigint, b bigint")
        self.parts = spark.createDataFrame([], "item bigint, component bigint")

    def add(self, more: DataFrame) -> None:
        """Join components by new links, as a graph of components: only what changes is walked."""
        links = store(self.apart(more, keep=True), "new")
        if links.isEmpty():
            return
        joined = connected(links, "c_a", "c_b")
        joined = joined.select(F.col("item").alias("__i"), F.col("component").alias("__c"))
        items = links.select(F.explode(F.array("a", "b")).alias("item")).distinct()
        parts = self.named(items, "item", "component").union(self.parts).distinct()
        parts = parts.join(joined, F.col("component") == F.col("__i"), "left")
        self.parts = store(parts.select("item", F.coalesce("__c", "component").alias("component")), "parts")

    def named(self, rows: DataFrame, item: str, to: str) -> DataFrame:
        parts = self.parts.select(F.col("item").alias("__i"), F.col("component").alias("__c"))
        rows = rows.join(parts, F.col(item) == F.col("__i"), "left")
        return rows.withColumn(to, F.coalesce("__c", item)).drop("__i", "__c")

    def apart(self, pairs: DataFrame, keep: bool = False) -> DataFrame:
        """Pairs of different components, with these if ``keep``."""
        rows = self.named(self.named(pairs, "a", "c_a"), "b", "c_b").filter("c_a <> c_b")
        return rows if keep else rows.drop("c_a", "c_b")


def _settle(pairs: DataFrame, classes: DataFrame, sets: DataFrame, found: _Links, percent: int, k: int) -> None:
    """Add the links among ``pairs``: first each item's best pair, then what is still apart."""
    pairs = store(_promising(found.apart(pairs), classes, percent, k), "promising")
    if pairs.isEmpty():
        return
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct(F.col("shared") / F.col("of"), -F.col("a"))).alias("a"))
    sure = store(_similar(best, sets, percent).select("a", "b"), "best")
    # what two best partners connect needs no test: an item's first partner, or that one's
    up = sure.select(F.col("b").alias("x"), F.col("a").alias("y"))
    near = up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left")
    near = near.select("x", F.coalesce("z", "y").alias("top"))
    rest = pairs.join(best, ["a", "b"], "left_anti").select("a", "b")
    for end in "ab":
        top = near.select(F.col("x").alias(end), F.col("top").alias(f"top_{end}"))
        rest = rest.join(top, end, "left").withColumn(f"top_{end}", F.coalesce(f"top_{end}", end))
    rest = rest.filter("top_a <> top_b").select("a", "b")
    found.add(sure.union(store(_similar(rest, sets, percent), "rest")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of ``size``-word shingles is at
    least ``percent`` / 100; components hold everything reachable by links.
    """
    if percent < 80:
        raise ValueError("runs of three sketch values find similarities of 0.8 and more")
    spark = docs.sparkSession
    sketched = store(sketch_documents(docs, size, k), "sketches")
    whole = sketched.filter("n > 0 and doc_id is not null")
    classes = whole.groupBy("n", "print").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    classes = store(classes, "classes")
    keyed = classes.select(F.explode(_run_keys(F.col("sketch"))).alias("key"), "id", "n", "print")
    members = _sized(keyed)
    sets = store(_full_sets(docs, members.select("id", "print").distinct(), size), "sets")
    members = members.select("key", "id", "n", F.lit(0).cast("long").alias("u"), "size")

    found = _Links(spark)

    def meet(lists: DataFrame) -> None:
        pairs = _pairs_of_short(lists.filter(F.col("size") <= SHORT), percent)
        _settle(pairs, classes, sets, found, percent, k)

    def still_open(lists: DataFrame) -> DataFrame:
        """The long lists that are not yet one component, and who is outside the largest one."""
        named = store(found.named(lists.drop("size", "tokens", "outside", "part"), "id", "part"), "named")
        parts = named.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
        largest = parts.groupBy("key").agg(
            F.max_by("part", F.struct("c", "part")).alias("most"),
            F.sum("c").alias("size"),
            F.sum("n").alias("tokens"),
            F.count(F.lit(1)).alias("parts"),
        )
        rows = named.join(largest.filter("parts > 1").drop("parts"), "key")
        rows = rows.withColumn("outside", F.col("part") != F.col("most")).drop("most")
        return store(rows, "open")

    meet(members)
    left = still_open(members.filter(F.col("size") > SHORT))
    if not left.isEmpty():
        # a few of the longest lists of each document are enough to gather large families
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("size"), "key"))
        longest = left.withColumn("place", place).filter(F.col("place") <= LONGEST)
        _settle(_stars(longest, _centres(longest, 1), percent), classes, sets, found, percent, k)
        left = still_open(left)
    if not left.isEmpty():
        lists, values = _rare_lists(left, sets, percent)
        meet(lists)
        left = still_open(lists.filter(F.col("size") > SHORT))
    if not left.isEmpty():
        # of documents whose lists are done, nothing needs to be known any more
        parts = found.named(left.select("id").distinct(), "id", "part")
        large = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > SHORT)
        owners = parts.join(large.select("part", F.col("part").alias("family")), "part", "left").drop("part")
        owners = store(owners, "families")
        values = values.join(left.select("id").distinct(), "id", "left_semi")
        allowed = store(_covered(values, owners, percent), "covered")
        left = store(left.join(owners, "id"), "open")
        while not left.isEmpty():
            chosen = _centres(left, CENTRES)
            found.add(store(_met(left, chosen, sets, allowed, percent), "met"))
            left = still_open(left.join(chosen.select("key", F.col("c").alias("id")), ["key", "id"], "left_anti"))

    classes = found.named(classes.drop("sketch"), "id", "part")
    rows = sketched.drop("sketch").join(
        classes.select(F.col("n").alias("__n"), F.col("print").alias("__p"), "part"),
        (F.col("n") == F.col("__n")) & (F.col("print") == F.col("__p")) & F.col("doc_id").isNotNull(),
        "left",
    )
    part = F.coalesce("part", "doc_id")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        part.alias("component_id"),
        part.eqNullSafe(F.col("doc_id")).alias("kept"),
    )
