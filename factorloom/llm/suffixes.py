"""Suffix-array dedup: repeated byte strings removed, blockwise, with a difference cover.

A byte goes when it is covered by a string of ``length`` bytes that also starts in a document with a
smaller id. Suffixes matter only through their first ``length`` bytes, and only where those occur in two documents.

1. Cover sample. Positions whose remainder modulo 21 lies in a difference cover are sampled (5 of 21), each with the
   30 bytes that follow. Wherever two suffixes begin, some offset below 21 is a sampled position of both, so
   two suffixes with a tie of 50 bytes have a sampled string in common that lies within it. The sample is sorted one bucket of
   hash values at a time and ranked: does its string lie in two documents or more? A suffix without such a
   string among its first 21 positions has no long tie and is done.
2. Suffix buckets. The other suffixes are dealt to buckets by the smallest 8-byte word (by hash) of their first 50
   bytes. Equal suffixes share a bucket, and neighbours mostly too, so runs of suffixes travel as the text that holds them.
   One set of buckets at a time is sorted by a 128-bit fingerprint of 50 bytes; among equal ones the smallest document
   id wins. Equal runs of one block of texts are reduced to those of its smallest document first, so
   a passage that a third of all documents share costs one entry per block.
3. What the groups find comes back by buckets of documents, packed, and meets the texts there; runs of starting
   positions are merged to spans.

Ranks of the sample are shared-or-not classes instead of places in a full order: a total order would have to
be shuffled with every position, and the result does not need it.

Cases: a null text is empty; texts shorter than ``length`` stay whole; a null doc_id counts as larger than
all others and null ids do not remove from each other; rows with an equal doc_id do not remove from each other;
repeats within one document stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import words
from factorloom.llm.packing import batch as packed_batch
from factorloom.llm.packing import group_of, heads_of, in_round, joined, numbers, packed, parts_of, spread
from factorloom.llm.storage import store

U64 = np.uint64
PERIOD = 21
COVER = np.array([0, 1, 4, 14, 16])  # any difference modulo 21 is one of two members
LENGTH = 50
WORD = 8
SAMPLE_BUCKETS = 5  # rounds over the sample
SUFFIX_BUCKETS = 1  # rounds over the suffixes left
GROUP_ENTRIES = 1_500_000  # of one group, sorted in one task
BUCKET_BYTES = 8_000_000  # of texts that are put together again in one task
LAST_ID = 2**63 - 1

_SALTS = np.random.default_rng(50).integers(1, 2**63, 16, dtype=np.uint64) | U64(1)


def string_hashes(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place, read as overlapping 8-byte words."""
    view = np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,))
    found = np.zeros(len(places), U64)
    for i, step in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        found = (found ^ (view[places + step] * _SALTS[i])) * U64(0x9FB21C651E98DF25)
        found ^= found >> U64(32)
    return words.mixed(found)


def sample_places(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and sampled position of each sampled string of texts of ``sizes`` bytes."""
    window = length - PERIOD + 1
    most = int(sizes.max()) if len(sizes) else 0
    pattern = (np.arange(0, most + 1, PERIOD)[:, None] + COVER[None, :]).ravel()
    counts = np.where(sizes >= length, np.searchsorted(pattern, sizes - window, "right"), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    return owner, pattern[np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)]


def candidate_suffixes(places: np.ndarray, size: int, length: int) -> np.ndarray:
    """Runs [from, to) of suffixes with a shared string at one of their first PERIOD positions."""
    first = np.maximum(places - PERIOD + 1, 0)
    last = np.minimum(places + 1, size - length + 1)
    places = last > first
    first, last = first[places], last[places]
    if not len(first):
        return np.zeros((0, 2), np.int64)
    # places ascend, so runs join where one begins within the one before
    head = np.ones(len(first), bool)
    head[1:] = first[1:] > last[:-1]
    return np.column_stack([first[head], last[np.append(head[1:], True)]])


FOUND = "bucket int, doc_ids binary, doc_keys binary, counts binary, places binary"
FOUND_KINDS = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("doc_ids", "doc_keys", "counts", "places")]])


def _per_bucket(docs, ids, keys, values: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket of documents: its documents with their values, in order."""
    own_ids, own_keys = ids[docs], keys[docs]
    bucket = own_keys % buckets  # never negative, like pmod
    order = np.lexsort((values[:, 0], own_ids, own_keys, bucket))
    own_ids, own_keys, bucket, values = own_ids[order], own_keys[order], bucket[order], values[order]
    rows = []
    for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1):
        if len(part):
            heads = heads_of(own_keys[part], own_ids[part])
            counts = np.diff(np.append(heads, len(part)))
            first = part[heads]
            rows.append((
                int(bucket[part[0]]), packed(own_ids[first], "<i8"), packed(own_keys[first], "<i8"),
                packed(counts, "<u4"), packed(values[part], "<u4"),
            ))
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(FOUND_KINDS.types)]
    return pa.Table.from_arrays(columns, schema=FOUND_KINDS)


class _Places:
    """Values per document of one bucket, put together from all groups."""

    def __init__(self, found: pa.Table, width: int):
        ids, keys = joined(found, "doc_ids", "<i8"), joined(found, "doc_keys", "<i8")
        values = joined(found, "places", "<u4").astype(np.int64).reshape(-1, width)
        owner = np.repeat(np.arange(len(ids)), joined(found, "counts", "<u4"))
        ids, keys = ids[owner], keys[owner]
        order = np.lexsort((values[:, 0], ids, keys))
        self.values, ids, keys = values[order], ids[order], keys[order]
        heads = heads_of(keys, ids) if len(order) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(order)) if len(order) else heads
        names = zip(ids[heads].tolist(), keys[heads].tolist(), strict=True)
        self.of = dict(zip(names, zip(heads.tolist(), ends.tolist(), strict=True), strict=True))
        self.none = np.zeros((0, width), np.int64)

    def get(self, doc_id: int, key: int) -> np.ndarray:
        where = self.of.get((doc_id, key))
        return self.none if where is None else self.values[where[0] : where[1]]


def _texts(table: pa.Table):
    """Number, id, key and bytes of each document of a bucket."""
    ids, keys = table["doc_id"].to_pylist(), table["key"].to_pylist()
    column = table["text"].combine_chunks()
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    n = 0
    for part in parts:
        data, offsets = words.buffers(part)
        for i in range(len(part)):
            yield n, ids[n], keys[n], data[offsets[i] : offsets[i + 1]]
            n += 1


SAMPLE = "r int, hashes binary, known binary, docs binary, places binary, own_docs binary, own_places binary, ids binary, keys binary"
RUNS = "r int, bytes binary, counts binary, docs binary, starts binary, own_docs binary, own_starts binary, own_counts binary, ids binary, keys binary"


def _sample_rows(hashes, owner, places, ids, keys, groups: int) -> list[tuple]:
    """Sampled strings of a block for each group.

    Strings in two documents of the block are settled here; one of each is sent on, as known.
    """
    if not len(hashes):
        return []
    order = np.argsort(hashes, kind="stable")
    hashes, owner, places = hashes[order], owner[order], places[order]
    heads, doc = heads_of(hashes), ids[owner]
    many = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
    many = spread(many, heads, len(hashes))
    first = np.zeros(len(hashes), bool)
    first[heads] = True
    rows = []
    for r, part in parts_of(group_of(hashes, groups)):
        go, stay = part[~many[part] | first[part]], part[many[part]]
        own, number = np.unique(np.concatenate([owner[go], owner[stay]]), return_inverse=True)
        rows.append((
            r, packed(hashes[go], "<u8"), packed(many[go], "u1"), packed(number[: len(go)], "<u4"),
            packed(places[go], "<u4"), packed(number[len(go) :], "<u4"), packed(places[stay], "<u4"),
            packed(ids[own], "<i8"), packed(keys[own], "<i8"),
        ))
    return rows


def _rank_sample(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Sort one group of the sample; the places of strings that lie in two documents."""
        docs, ids, keys, places = _shared_sample(table)
        return _per_bucket(docs, ids, keys, places[:, None], buckets)

    return run


def _shared_sample(table: pa.Table):
    hashes, known = joined(table, "hashes", "<u8"), joined(table, "known", "u1")
    ids, keys = joined(table, "ids", "<i8"), joined(table, "keys", "<i8")
    docs, places = numbers(table, "docs"), joined(table, "places", "<u4")
    if len(hashes):
        order = np.argsort(hashes, kind="stable")
        heads, doc = heads_of(hashes[order]), ids[docs[order]]
        shared = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
        shared |= np.maximum.reduceat(known[order], heads) > 0
        hit = order[spread(shared, heads, len(order))]
        docs, places = docs[hit], places[hit]
    docs = np.concatenate([docs, numbers(table, "own_docs")])
    places = np.concatenate([places, joined(table, "own_places", "<u4")])
    return docs, ids, keys, places


def smallest_words(data: np.ndarray, length: int) -> np.ndarray:
    """For each place the smallest hash of the 8-byte words inside its ``length`` bytes."""
    view = np.ndarray(max(0, len(data) - WORD + 1), "<u8", np.ascontiguousarray(data), strides=(1,))
    low = words.mixed(view * _SALTS[10])
    span, width = 1, length - WORD + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (width - span)], low[width - span :])


def _run_rows(data, at, owner, starts, ids, keys, length, number, rounds, groups) -> list[tuple]:
    """Runs of suffixes of a block that share their smallest word, for each group.

    A run whose text lies in a smaller document of the block is settled here.
    """
    word = smallest_words(data, length)[at]
    new = np.ones(len(at), bool)
    new[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(at)))
    word, begin, owner, starts = word[heads], at[heads], owner[heads], starts[heads]
    word = words.mixed(word)
    mine = in_round(word, number, rounds)
    word, begin, owner, starts, counts = (x[mine] for x in (word, begin, owner, starts, counts))
    if not len(word):
        return []
    end = begin + counts + length - 1
    text = words.hashes(data, begin, end, fold=False)
    order = np.lexsort((counts, text))
    first = heads_of(text[order], counts[order])
    doc = ids[owner]
    low = np.empty(len(order), np.int64)
    low[order] = spread(np.minimum.reduceat(doc[order], first), first, len(order))
    settled = doc > low
    rows = []
    for r, part in parts_of(group_of(word, groups)):
        go, stay = part[~settled[part]], part[settled[part]]
        own, number_ = np.unique(np.concatenate([owner[go], owner[stay]]), return_inverse=True)
        rows.append((
            r, b"".join(data[a:b].tobytes() for a, b in zip(begin[go].tolist(), end[go].tolist())),
            packed(counts[go], "<u4"), packed(number_[: len(go)], "<u4"), packed(starts[go], "<u4"),
            packed(number_[len(go) :], "<u4"), packed(starts[stay], "<u4"), packed(counts[stay], "<u4"),
            packed(ids[own], "<i8"), packed(keys[own], "<i8"),
        ))
    return rows


def _sort_runs(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Sort the suffixes of one group; runs of those that start in a smaller document too."""
        data, counts = joined(table, "bytes", "u1"), joined(table, "counts", "<u4").astype(np.int64)
        ids, keys = joined(table, "ids", "<i8"), joined(table, "keys", "<i8")
        docs, starts = numbers(table, "docs"), joined(table, "starts", "<u4").astype(np.int64)
        found = np.zeros((0, 2), np.int64)
        found_docs = np.zeros(0, np.int64)
        if len(counts):
            run_of = np.repeat(np.arange(len(counts)), counts)
            within = np.arange(len(run_of)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = within + np.repeat(np.cumsum(counts + length - 1) - (counts + length - 1), counts)
            one = string_hashes(data, at, length)
            other = words.mixed(string_hashes(data, at + 1, length - 2) ^ _SALTS[11]) + one
            order = np.argsort(one, kind="stable")
            if ((one[order][1:] == one[order][:-1]) & (other[order][1:] != other[order][:-1])).any():
                order = np.lexsort((other, one))
            heads = heads_of(one[order], other[order])
            doc = ids[docs[run_of]]
            low = np.minimum.reduceat(doc[order], heads)
            later = np.zeros(len(order), bool)
            later[order] = doc[order] > spread(low, heads, len(order))
            hit = np.flatnonzero(later)
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (run_of[hit[1:]] != run_of[hit[:-1]])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(hit)))
            hit = hit[first]
            found_docs = docs[run_of[hit]]
            found = np.column_stack([starts[run_of[hit]] + within[hit], sizes])
        own = np.column_stack([joined(table, "own_starts", "<u4"), joined(table, "own_counts", "<u4")])
        docs = np.concatenate([found_docs, numbers(table, "own_docs")])
        return _per_bucket(docs, ids, keys, np.concatenate([found, own]), buckets)

    return run


def _sample_scan(number: int, rounds: int, groups: int, length: int):
    window = length - PERIOD + 1

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            for first, last, data, offsets in words.blocks(batch.column("text")):
                owner, places = sample_places(np.diff(offsets), length)
                if not len(owner):
                    continue
                hashes = string_hashes(data, places + offsets[owner], window)
                mine = in_round(hashes, number, rounds)
                rows = _sample_rows(
                    hashes[mine], owner[mine], places[mine], ids[first:last], keys[first:last], groups
                )
                if rows:
                    yield packed_batch(rows, SAMPLE)

    return run


def _suffix_scan(number: int, rounds: int, groups: int, length: int):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            starts = batch.column("start").to_numpy()
            for first, last, data, offsets in words.blocks(batch.column("bytes")):
                counts = np.diff(offsets) - length + 1
                owner = np.repeat(np.arange(last - first), counts)
                own = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = _run_rows(
                    data, own + np.repeat(offsets[:-1], counts), owner, own + starts[first:last][owner],
                    ids[first:last], keys[first:last], length, number, rounds, groups,
                )
                if rows:
                    yield packed_batch(rows, RUNS)

    return run


def _regions(length: int):
    """Texts of the suffixes that are left: one row per run."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = _Places(found, 1)
        rows = [[], [], [], []]
        for _, doc_id, key, text in _texts(texts):
            for a, b in candidate_suffixes(places.get(doc_id, key)[:, 0], len(text), length).tolist():
                for column, value in zip(rows, (doc_id, key, a, text[a : b + length - 1].tobytes()), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
        return pa.Table.from_arrays(columns, names=["doc_id", "key", "start", "bytes"])

    return run


def _kept(length: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = _Places(found, 2)
        sizes, removed, spans, kept = [], [], [], []
        for _, doc_id, key, text in _texts(texts):
            runs = places.get(doc_id, key)
            change = np.bincount(runs[:, 0], minlength=len(text) + 1)
            change -= np.bincount(runs[:, 0] + runs[:, 1] + length - 1, minlength=len(text) + 1)
            gone = np.cumsum(change[:-1]) > 0
            sizes.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            kept.append(text[~gone].tobytes())
        numbers_ = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
        columns = [texts["own_id"].combine_chunks(), *numbers_, words.packed(kept)]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _rounds(rows: DataFrame, scan, schema: str, settle, rounds: int, groups: int, length: int, label: str):
    """What each bucket finds, one bucket sorted after the other."""
    found = []
    for i in range(rounds):
        entries = rows.mapInArrow(scan(i, rounds, groups, length), schema)
        found.append(store(entries.groupBy("r").applyInArrow(settle, FOUND), label))
    return reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    spark = docs.sparkSession
    if length < PERIOD + WORD:
        raise ValueError(f"strings of at least {PERIOD + WORD} bytes are needed")
    text = F.coalesce("text", F.lit("")).cast("binary")
    own = F.col("doc_id").cast("long")
    rows = docs.select(own.alias("own_id"), F.coalesce(own, F.lit(LAST_ID)).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    partitions = spark.sparkContext.defaultParallelism
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions, math.ceil(total / BUCKET_BYTES))
    # equal texts in many documents share a key, so the id takes part in the bucket
    rows = rows.withColumn("key", F.xxhash64("doc_id", "key"))
    texts = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))

    entries = total * len(COVER) / PERIOD / SAMPLE_BUCKETS
    groups = max(partitions, math.ceil(entries / GROUP_ENTRIES))
    sampled = rows.select("doc_id", "key", "text")
    shared = _rounds(sampled, _sample_scan, SAMPLE, _rank_sample(buckets), SAMPLE_BUCKETS, groups, length, "cover")
    regions = texts.select("bucket", "doc_id", "key", "text").groupBy("bucket").cogroup(shared.groupBy("bucket"))
    regions = store(
        regions.applyInArrow(_regions(length), "doc_id bigint, key bigint, start bigint, bytes binary"), "regions"
    )
    total = regions.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    groups = max(partitions, math.ceil(total / SUFFIX_BUCKETS / GROUP_ENTRIES))
    sort = _sort_runs(length, buckets)
    found = _rounds(regions, _suffix_scan, RUNS, sort, SUFFIX_BUCKETS, groups, length, "suffixes")
    return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(
        _kept(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
