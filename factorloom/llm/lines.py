"""Line dedup by an exact set-similarity join of line tokens.

A line is the set of its words in lower case. Lines of all documents are ordered by doc_id and place; a line goes when
an earlier one has a Jaccard similarity of at least ``percent`` / 100 with it, whether or not that one stays.

1. Rarity. All words are counted in a table of fixed size by their hash; words are ordered by count, then hash.
2. Lines with equal sets: in a block of texts the first one speaks for all; then they meet by a 128-bit fingerprint of the set.
3. Similar lines share a word among the first ``n - ceil(n * percent / 100) + 1`` in order of rarity.
   Lists of lines by such words are walked from each line back to earlier ones. Pairs must
   pass the length filter, the positional filter and a bound on the symmetric difference
   from the parities of 64 word classes, and of up to 1024 for lines of more than ``NARROW`` words. A line that has met ``NEAREST`` promising partners in a list stops there, which keeps
   families of thousands of similar lines linear; a list in which lines stopped is kept, once.
4. The whole sets decide. They are read from the texts of the lines that a table of fixed size, of bits by hash, holds for the pairs, so
   texts stay where they are. Lines that stopped early and were not removed walk the kept lists to the end.

Cases: a null text has one empty line; a line without words always stays; lines of rows with the same doc_id and
place do not count as earlier than each other; repeated words count once; texts end up with the
lines that stay, joined by line breaks; an empty table gives an empty result; other columns stay as they are.
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
from factorloom.llm.packing import (
    group_of,
    heads_of,
    joined,
    joined_planes,
    numbers,
    packed,
    parts_of,
    planes,
    spread,
)
from factorloom.llm.storage import store

U64 = np.uint64
PERCENT = 80
COUNT_BITS = 20
COUNT_PART = 4096
NEAREST = 4
GROUP_BYTES = 8_000_000  # of text for one group task
BLOCK = 1 << 20  # of text that a task takes at a time
LINE = 0x0A
NARROW = 80  # words of a line that 64 parities tell apart; with each doubling the parities double
LEVELS = 4
WIDE = 64 << LEVELS
LONG_LINES = 1024  # that are mapped at once
FILTER_BITS = 25
FILTER_PART = 4096
_SALTS = np.random.default_rng(8).integers(1, 2**63, 2, dtype=np.uint64)

ENTRIES = (
    "r int, ones binary, twos binary, set_docs binary, set_lines binary, tokens binary, maps binary, sizes binary, "
    "marks binary, spots binary, more binary, docs binary, lines binary, gone_docs binary, gone_lines binary, ids binary, keys binary"
)
MET = (
    "kind int, r int, doc_id bigint, key bigint, line int, other_id bigint, other_key bigint, other_line int, "
    "token bigint, held binary, apart double"
)
PART = "part int, held binary"
GONE, PAIR, OPEN, LIST = 0, 1, 2, 3
HELD = np.dtype([
    ("ids", "<i8"), ("keys", "<i8"), ("line", "<u4"), ("size", "<u4"), ("spot", "<u2"), ("maps", "<u8"),
])


# ---- lines of a block ------------------------------------------------------------------------


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and number of each line of a block; every text has at least one line."""
    breaks = np.flatnonzero(data == LINE)
    breaks_of = words.owners(breaks, offsets)
    owner = np.concatenate([np.arange(len(offsets) - 1), breaks_of])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, owner))
    owner, starts = owner[order], starts[order]
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    return starts, owner, np.arange(len(owner)) - first[owner]


def line_words(data, offsets, starts, owner) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of each word. A line that begins where its text ends has no words."""
    begin, end = words.bounds(data, offsets, words.SPACES)
    found = words.hashes(data, begin, end, fold=True)
    # of lines with the same start the last one holds the words: the ones before are empty texts
    return np.searchsorted(starts, begin, "right") - 1, found


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> U64(64 - COUNT_BITS)).astype(np.int64)


def _fixed_table(parts: DataFrame, kind: str, part: int, size: int, combine: np.ufunc) -> np.ndarray:
    """A table of fixed size from (part, held) rows of all tasks."""

    def merge(table: pa.Table) -> pa.Table:
        total = reduce(combine, (np.frombuffer(x, kind) for x in table["held"].to_pylist()))
        return pa.table({"part": table["part"][:1], "held": words.packed([total.tobytes()])})

    total = np.zeros(size, kind)
    for row in parts.groupBy("part").applyInArrow(merge, PART).collect():
        total[row["part"] * part : (row["part"] + 1) * part] = np.frombuffer(row["held"], kind)
    return total


def _parts(total: np.ndarray, part: int):
    cut = total.reshape(-1, part)
    some = np.flatnonzero(cut.any(axis=1))
    if len(some):
        held = words.packed([x.tobytes() for x in cut[some]])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), held], ["part", "held"])


def count_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often the words of each bucket occur in all texts, and bytes of all texts; the table has a fixed size."""
    size = 2**COUNT_BITS

    def count(batches):
        total = np.zeros(size + COUNT_PART, np.int64)
        for batch in batches:
            for _, _, data, offsets in words.blocks(batch.column("text"), BLOCK):
                begin, end = words.bounds(data, offsets, words.SPACES)
                total[:size] += np.bincount(_bucket(words.hashes(data, begin, end, fold=True)), minlength=size)
                total[size] += len(data)
        yield from _parts(total, COUNT_PART)

    found = _fixed_table(
        docs.select("text").mapInArrow(count, PART), "<i8", COUNT_PART, size + COUNT_PART, np.add
    )
    return found[:size], int(found[size])


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(n * percent / 100)"""
    return -(-n * percent // 100)


def _rarest_first(line: np.ndarray, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of the distinct words of each line, by the count of the word, then by hash."""
    rarity = np.minimum(counts[_bucket(found)], (1 << 24) - 1).astype(U64) << U64(40) | found >> U64(24)
    bits = int(line[-1]).bit_length()
    key = rarity >> U64(bits) | (line.astype(U64) << U64(63 - bits) << U64(1))
    order = np.argsort(key)
    key, words_of = key[order], found[order]
    same = key[1:] == key[:-1]
    if (same & (words_of[1:] != words_of[:-1])).any():  # words of a line that the first bits do not order
        order = np.lexsort((found, rarity, line))
        line, found = line[order], found[order]
        heads = heads_of(line, found)
        return line[heads], found[heads]
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    return line[order[heads]], words_of[heads]


def _extra(size: np.ndarray) -> np.ndarray:
    """Words of 64 parities that a line has besides its first."""
    return (1 << np.searchsorted(NARROW << np.arange(LEVELS), size)) - 1


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as its count."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _more_maps(found: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parities besides the first 64, a row for each long line, and the row of each line.

    Half of a doubled map folds on the other to the map before it, so only one half of each is kept.
    """
    long = np.flatnonzero(sizes > NARROW)
    row = np.cumsum(sizes > NARROW) - 1
    made = [np.zeros((0, (WIDE >> 6) - 1), U64)]
    for first in range(0, len(long), LONG_LINES):
        some = long[first : first + LONG_LINES]
        place = np.repeat(np.arange(len(some)) * WIDE, sizes[some])
        place += (found[_ragged(heads[some], sizes[some])] & U64(WIDE - 1)).astype(np.int64)
        odd = np.bincount(place, minlength=len(some) * WIDE) & 1
        maps = np.packbits(odd.astype(bool), bitorder="little").view("<u8").reshape(len(some), -1)
        kept = []
        while maps.shape[1] > 1:
            low, high = np.split(maps, 2, axis=1)
            kept.insert(0, high)
            maps = low ^ high
        made.append(np.concatenate(kept, axis=1))
    return np.concatenate(made), row


def _entries(data, offsets, ids, keys, counts, groups: int, percent: int) -> list[tuple]:
    """What a block sends to each group, see the columns of ENTRIES."""
    starts, owner, number = line_starts(data, offsets)
    line, found = line_words(data, offsets, starts, owner)
    if not len(line):
        return []
    # the distinct words of each line, rarest first, then by hash
    line, found = _rarest_first(line, found, counts)
    heads = heads_of(line)
    sizes = np.diff(np.append(heads, len(line)))
    spot = np.arange(len(line)) - np.repeat(heads, sizes)
    # parities: words that two lines share cancel, so maps of long lines tell them apart as well
    maps = np.bitwise_xor.reduceat(U64(1) << (found & U64(63)), heads)
    more, more_row = _more_maps(found, heads, sizes)
    extra = _extra(sizes)
    ones = np.add.reduceat(words.mixed(found ^ _SALTS[0]), heads)
    twos = np.add.reduceat(words.mixed(found ^ _SALTS[1]), heads)
    where = line[heads]  # lines with words
    doc, place = owner[where], number[where]
    # in the block, the earliest of equal sets speaks for all
    order = np.lexsort((place, ids[doc], twos, ones))
    first = heads_of(ones[order], twos[order])
    head = order[_spread_places(first, len(order))]
    same = np.empty(len(order), np.int64)
    same[order] = head
    later = (ids[doc] != ids[doc[same]]) | (place != place[same])
    gone = later
    speaks = ~later & (same == np.arange(len(same)))
    # words of the prefix, of lines that can have a similar line with another set
    chosen = speaks & (sizes * 100 >= percent * (sizes + 1))
    prefix = spot < np.repeat(np.where(chosen, sizes - _needed(sizes, percent) + 1, 0), sizes)
    of = np.repeat(np.arange(len(heads)), sizes)[prefix]
    token, spot = found[prefix], spot[prefix]
    sent = np.flatnonzero(speaks)
    out = np.flatnonzero(gone)
    group = np.concatenate([group_of(ones[sent], groups), group_of(token, groups), group_of(ones[out], groups)])
    a, b = len(sent), len(sent) + len(token)
    rows = []
    for r, part in parts_of(group):
        s, t, g = sent[part[part < a]], part[(part >= a) & (part < b)] - a, out[part[part >= b] - b]
        l = of[t]
        docs = np.concatenate([doc[s], doc[l], doc[g]])
        own, ordinal = np.unique(docs, return_inverse=True)
        x, y, z = np.split(ordinal, [len(s), len(s) + len(l)])
        rows.append((
            r, packed(ones[s], "<u8"), packed(twos[s], "<u8"), planes(x, "<u4"), planes(place[s], "<u4"),
            packed(token[t] >> U64(32), "<u4"), packed(maps[l], "<u8"), planes(sizes[l], "<u4"),
            packed(ones[l] >> U64(32), "<u4"), planes(np.minimum(spot[t], 65535), "<u2"),
            packed(more.ravel()[_ragged(more_row[l] * more.shape[1], extra[l])], "<u8"), planes(y, "<u4"),
            planes(place[l], "<u4"), planes(z, "<u4"), planes(place[g], "<u4"),
            planes(ids[own], "<i8"), packed(keys[own], "<i8"),
        ))
    return rows


def _spread_places(heads: np.ndarray, size: int) -> np.ndarray:
    return spread(heads, heads, size)


# ---- group tasks -----------------------------------------------------------------------------


class _Lists:
    """Entries of one group in lists by word, each in order of lines."""

    def __init__(self, table: pa.Table, percent: int):
        self.ids, self.keys = joined_planes(table, "ids", "<i8"), joined(table, "keys", "<i8")
        token, docs = joined(table, "tokens", "<u4"), numbers(table, "docs", joined_planes)
        line, size = joined_planes(table, "lines", "<u4"), joined_planes(table, "sizes", "<u4").astype(np.int64)
        maps, mark = joined(table, "maps", "<u8"), joined(table, "marks", "<u4")
        order = np.lexsort((line, self.ids[docs], token))
        # equal sets are settled by their fingerprints: only the first of them stays in a list
        marked = (token.astype(U64) << U64(32)) | mark
        again = np.argsort(words.mixed(marked ^ words.mixed(maps ^ words.mixed(size.astype(U64))))[order])
        first = heads_of(marked[order][again], maps[order][again], size[order][again])
        keep = np.zeros(len(order), bool)
        if len(order):
            keep[np.minimum.reduceat(again, first)] = True
        order = order[keep]
        self.token, self.docs, self.line = token[order], docs[order], line[order]
        self.maps = maps[order]
        self.spot = joined_planes(table, "spots", "<u2")[order].astype(np.int64)
        extra = _extra(size)
        self.more, self.more_at = joined(table, "more", "<u8"), (np.cumsum(extra) - extra)[order]
        self._sizes(size[order], percent)
        self.heads = heads_of(self.token) if len(order) else np.zeros(0, np.int64)
        self.rank = np.arange(len(order)) - spread(self.heads, self.heads, len(order))

    def _sizes(self, size: np.ndarray, percent: int):
        """Sizes of entries, and between which the sizes of similar ones are."""
        self.extra, self.percent = _extra(size), percent
        self.size, self.least, self.most = (x.astype(np.int32) for x in (size, _needed(size, percent), size * 100 // percent))

    @classmethod
    def of_held(cls, held: bytes, percent: int) -> _Lists:
        """One list as ``held`` gives it."""
        count, lists = int.from_bytes(held[:8], "little"), cls.__new__(cls)
        rows = np.frombuffer(held, HELD, count, 8)
        lists.ids, lists.keys, lists.docs = rows["ids"], rows["keys"], np.arange(count)
        lists.line, lists.maps, lists.spot = rows["line"], rows["maps"], rows["spot"].astype(np.int64)
        lists.rank = np.arange(count)
        lists._sizes(rows["size"].astype(np.int64), percent)
        lists.more, lists.more_at = np.frombuffer(held[8 + rows.nbytes :], "<u8"), np.cumsum(lists.extra) - lists.extra
        return lists

    def held(self, r: int, stopped: np.ndarray) -> pa.Table:
        """The lists in which entries stopped, one row each."""
        which = np.unique(np.searchsorted(self.heads, stopped, "right") - 1)
        ends, found = np.append(self.heads[1:], len(self.token)), []
        for a, b in zip(self.heads[which].tolist(), ends[which].tolist(), strict=True):
            rows, docs = np.empty(b - a, HELD), self.docs[a:b]
            rows["ids"], rows["keys"], rows["line"] = self.ids[docs], self.keys[docs], self.line[a:b]
            rows["size"], rows["spot"], rows["maps"] = self.size[a:b], self.spot[a:b], self.maps[a:b]
            more = self.more[_ragged(self.more_at[a:b], self.extra[a:b])]
            found.append((b - a).to_bytes(8, "little") + rows.tobytes() + more.tobytes())
        none = np.zeros(len(which), np.int64)
        return _met(LIST, r, *[none] * 6, self.token[self.heads[which]], found)

    def passing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the pairs of entries that the filters cannot rule out."""
        n = self.size[y]
        at = np.flatnonzero((n >= self.least[x]) & (n <= self.most[x]))
        return at[self._close(x[at], y[at])]

    def _close(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs whose sizes are similar."""
        m, n = self.size[x], self.size[y]
        need = -(-self.percent * (m + n).astype(np.int64) // (100 + self.percent))
        left = np.flatnonzero((m - self.spot[x] >= need) & (n - self.spot[y] >= need))
        x, y, room = x[left], y[left], (m + n - 2 * need)[left]
        near = np.flatnonzero(np.bitwise_count(self.maps[x] ^ self.maps[y]) <= room)
        left, x, y, room = left[near], x[near], y[near], room[near]
        # a place is earlier than another only if it is not the same one
        other = (self.ids[self.docs[x]] != self.ids[self.docs[y]]) | (self.line[x] != self.line[y])
        return left[other & (self.apart(x, y) <= room)]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Parities that differ, at most the words that do, by the finest map that both lines have."""
        differ = (self.maps[x] ^ self.maps[y])[:, None]
        found = np.bitwise_count(differ[:, 0]).astype(np.int64)
        extra, at = np.minimum(self.extra[x], self.extra[y]), np.arange(len(x))
        for level in range(LEVELS):
            finer = np.flatnonzero(extra[at] >> level)
            if not len(finer):
                break
            at, half = at[finer], (1 << level) - 1 + np.arange(1 << level)
            one, other = (self.more[self.more_at[of[at]][:, None] + half] for of in (x, y))
            high = one ^ other
            differ = np.concatenate([differ[finer] ^ high, high], axis=1)
            found[at] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        return found

    def walk(self, at: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (entry, earlier entry) that pass, and entries that stopped after ``most`` pairs."""
        ones, others, stopped = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not most:
            for i in at.tolist():
                earlier = np.arange(i - self.rank[i], i)
                good = self.passing(np.full(len(earlier), i), earlier)
                ones.append(np.full(len(good), i))
                others.append(earlier[good])
            return np.concatenate(ones), np.concatenate(others), stopped[0]
        # those that have the most before them first, so the ones that go on stand in front
        at = at[np.argsort(-self.rank[at], kind="stable")]
        before, least, most_words, other = -self.rank[at], self.least[at], self.most[at], at.copy()
        count, step = np.zeros(len(at), np.int64), 1
        while end := int(np.searchsorted(before, -step, "right")):
            other[:end] -= 1
            n = self.size[other[:end]]
            good = np.flatnonzero((n >= least[:end]) & (n <= most_words[:end]))
            good = good[self._close(at[good], other[good])]
            if len(good):
                ones.append(at[good])
                others.append(other[good])
                count[good] += 1
                full = good[count[good] >= most]
                if len(full):
                    stopped.append(at[full[before[full] < -step]])
                    left = np.ones(len(at), bool)
                    left[full] = False
                    before, least, most_words = before[left], least[left], most_words[left]
                    at, other, count = at[left], other[left], count[left]
            step += 1
        return np.concatenate(ones), np.concatenate(others), np.concatenate(stopped)

    def rows(self, kind: int, r: int, one: np.ndarray, other: np.ndarray) -> pa.Table:
        a, b = self.docs[one], self.docs[other]
        token = self.token[one] if kind == OPEN else None
        apart = self.apart(one, other) / (self.size[one] + self.size[other]) if kind == PAIR else None
        return _met(
            kind, r, self.ids[a], self.keys[a], self.line[one], self.ids[b], self.keys[b], self.line[other], token,
            apart=apart,
        )


def _met(kind, r, ids, keys, line, other_id, other_key, other_line, token=None, held=None, apart=None) -> pa.Table:
    n = len(ids)
    return pa.table({
        "kind": pa.array(np.full(n, kind), pa.int32()), "r": pa.array(np.full(n, r), pa.int32()),
        "doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()),
        "line": pa.array(line.astype(np.int32)), "other_id": pa.array(other_id, pa.int64()),
        "other_key": pa.array(other_key, pa.int64()), "other_line": pa.array(other_line.astype(np.int32)),
        "token": pa.nulls(n, pa.int64()) if token is None else pa.array(token.astype(np.int64)),
        "held": pa.nulls(n, pa.binary()) if held is None else pa.array(held, pa.binary()),
        "apart": pa.nulls(n, pa.float64()) if apart is None else pa.array(apart, pa.float64()),
    })


def _equal_sets(table: pa.Table, r: int) -> pa.Table:
    """Lines whose set an earlier line has, of this group."""
    ids, keys = joined_planes(table, "ids", "<i8"), joined(table, "keys", "<i8")
    ones, twos = joined(table, "ones", "<u8"), joined(table, "twos", "<u8")
    docs, line = numbers(table, "set_docs", joined_planes), joined_planes(table, "set_lines", "<u4")
    gone_docs, gone_lines = numbers(table, "gone_docs", joined_planes), joined_planes(table, "gone_lines", "<u4")
    if len(ones):
        order = np.lexsort((line, ids[docs], twos, ones))
        head = order[_spread_places(heads_of(ones[order], twos[order]), len(order))]
        later = (ids[docs[order]] != ids[docs[head]]) | (line[order] != line[head])
        gone_docs = np.concatenate([gone_docs, docs[order[later]]])
        gone_lines = np.concatenate([gone_lines, line[order[later]]])
    i, k = ids[gone_docs], keys[gone_docs]
    return _met(GONE, r, i, k, gone_lines, i, k, gone_lines)


def _meet(percent: int):
    def run(table: pa.Table) -> pa.Table:
        r = table["r"][0].as_py()
        lists = _Lists(table, percent)
        one, other, stopped = lists.walk(np.arange(len(lists.rank)), NEAREST)
        parts = [_equal_sets(table, r), lists.rows(PAIR, r, one, other), lists.rows(OPEN, r, stopped, stopped)]
        return pa.concat_tables([*parts, lists.held(r, stopped)])

    return run


def _walk_held(percent: int):
    """Pairs of the ``wanted`` lines with the earlier ones of their held lists."""

    def run(batches):
        for batch in batches:
            for r, held, lines in zip(*(batch.column(c).to_pylist() for c in ("r", "held", "wanted")), strict=True):
                lists = _Lists.of_held(held, percent)
                wanted = {(x["doc_id"], x["key"], x["line"]) for x in lines}
                mine = zip(lists.ids.tolist(), lists.keys.tolist(), lists.line.tolist(), strict=True)
                one, other, _ = lists.walk(np.array([i for i, x in enumerate(mine) if x in wanted], np.int64), None)
                yield from lists.rows(PAIR, r, one, other).to_batches()

    return run


# ---- the operator ----------------------------------------------------------------------------


LINE_KEY = ["doc_id", "key", "line"]


def _filter_places(ids: np.ndarray, keys: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The bit of each line."""
    found = words.mixed(keys.astype(np.int64).view(U64) ^ words.mixed(ids.astype(np.int64).view(U64)))
    return words.mixed(found + line.astype(U64)) >> U64(64 - FILTER_BITS)


def _line_filter(needed: DataFrame) -> np.ndarray:
    """Bits of the lines of ``needed``; the table has a fixed size, and a line beside them has its bit set at times."""

    def mark(batches):
        total = np.zeros(2**FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            at = np.unique(_filter_places(*(batch.column(c).to_numpy() for c in LINE_KEY)))
            np.bitwise_or.at(total, at >> U64(3), np.uint8(1) << (at & U64(7)).astype(np.uint8))
        yield from _parts(total, FILTER_PART)

    return _fixed_table(
        needed.select(*LINE_KEY).mapInArrow(mark, PART), "u1", FILTER_PART, 2**FILTER_BITS >> 3, np.bitwise_or
    )


def _token_sets(bits):
    """Distinct words of the lines whose bit is set."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for first, last, data, offsets in words.blocks(batch.column("text"), BLOCK):
                starts, owner, number = line_starts(data, offsets)
                owner += first
                place = _filter_places(ids.to_numpy()[owner], keys.to_numpy()[owner], number)
                held = bits.value[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1
                chosen = np.flatnonzero(held)
                if not len(chosen):
                    continue
                sizes = np.append(starts[1:], len(data))[chosen] - starts[chosen]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                line, found = words.word_hashes(data[_ragged(starts[chosen], sizes)], ends)
                cuts = np.searchsorted(line, np.arange(len(chosen) + 1)).tolist()
                tokens = [np.unique(found[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
                take = pa.array(owner[chosen])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(number[chosen], pa.int32()), words.packed(tokens)],
                    [*LINE_KEY, "tokens"],
                )

    return run


def _verified(keyed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Lines of ``pairs`` whose whole set is similar to the other's."""
    names = [f"other_{c}" for c in ("id", "key", "line")]
    pairs = store(pairs.select(*LINE_KEY, *names, "apart").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs.select(*LINE_KEY)
    others = pairs.select(*[F.col(c).alias(n) for c, n in zip(names, LINE_KEY)])
    bits = keyed.sparkSession.sparkContext.broadcast(_line_filter(pairs.select(*LINE_KEY).union(others)))
    made = keyed.mapInArrow(_token_sets(bits), "doc_id bigint, key bigint, line int, tokens binary")
    sets = store(made.dropDuplicates(LINE_KEY), "tokens")

    @F.arrow_udf("boolean")
    def alike(one: pa.Array, other: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(one.to_pylist(), other.to_pylist(), strict=True):
            a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            found.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.array(found, pa.bool_())

    second = sets.select(*[F.col(n).alias(c) for c, n in zip(names, LINE_KEY)], F.col("tokens").alias("others"))

    def hold(chosen: DataFrame) -> DataFrame:
        rows = chosen.join(sets, LINE_KEY).join(second, names)
        return store(rows.filter(alike(F.col("tokens"), F.col("others"))).select(*LINE_KEY).distinct(), "alike")

    # the partner that seems nearest first; other partners only of lines that it does not settle
    best = F.min_by(F.struct(*names), F.struct("apart", *names)).alias("b")
    first = pairs.groupBy(*LINE_KEY).agg(best).select(*LINE_KEY, "b.*")
    settled = hold(first)
    rest = pairs.drop("apart").join(first, [*LINE_KEY, *names], "left_anti").join(settled, LINE_KEY, "left_anti")
    rest = store(rest, "rest")
    return settled if rest.isEmpty() else settled.union(hold(rest))


def similar_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The lines that go: (doc_id, key, lines), ``key`` being the hash of the text."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a null id is larger than all others
    keyed = keyed.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    table, total = count_words(keyed)
    counts = spark.sparkContext.broadcast(table)
    groups = max(spark.sparkContext.defaultParallelism, math.ceil(total / GROUP_BYTES))

    def scan(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            for first, last, data, offsets in words.blocks(batch.column("text"), BLOCK):
                rows = _entries(data, offsets, ids[first:last], keys[first:last], counts.value, groups, percent)
                if rows:
                    yield packed_batch(rows, ENTRIES)

    entries = keyed.mapInArrow(scan, ENTRIES)
    met = store(entries.groupBy("r").applyInArrow(_meet(percent), MET), "met")
    gone = met.filter(F.col("kind") == GONE).select(*LINE_KEY).distinct()
    pairs = met.filter(F.col("kind") == PAIR).join(gone, LINE_KEY, "left_anti")
    gone = store(gone.union(_verified(keyed, pairs, percent)), "gone")
    still = met.filter(F.col("kind") == OPEN).join(gone, LINE_KEY, "left_anti")
    still = store(still.groupBy("r", "token").agg(F.collect_set(F.struct(*LINE_KEY)).alias("wanted")), "open")
    if not still.isEmpty():
        more = met.filter(F.col("kind") == LIST).select("r", "token", "held").join(still, ["r", "token"])
        gone = gone.union(_verified(keyed, more.mapInArrow(_walk_held(percent), MET), percent))
    return gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def remove_similar_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with texts of the lines that stay, and __n_lines, __gone (numbers of the lines that went)."""

    @F.arrow_udf("string")
    def without(text: pa.Array, gone: pa.Array) -> pa.Array:
        found = []
        for t, g in zip(text, gone.to_pylist(), strict=True):
            if g is None:
                found.append(None)
                continue
            out = set(g)
            found.append("\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i not in out))
        return pa.array(found, pa.string())

    gone = similar_lines(docs, percent).withColumnsRenamed({"doc_id": "__i", "key": "__k", "lines": "__gone"})
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "__key": F.xxhash64(text)}
    )
    # a list for each text, so they are looked up and the texts are not sorted
    rows = rows.join(gone.hint("shuffle_hash"), (F.col("__id") == F.col("__i")) & (F.col("__key") == F.col("__k")), "left")
    changed = without(F.when(F.col("__gone").isNotNull(), text), F.col("__gone"))
    without_breaks = F.replace(text, F.lit("\n"), F.lit(""))
    rows = rows.withColumn("__n_lines", F.octet_length(text) - F.octet_length(without_breaks) + 1)
    rows = rows.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(changed))
    return rows.select(*docs.columns, "__n_lines", "__gone")
