"""Fill-in-middle: cut a text in three and move the middle to the end.

A cut is drawn in units (a run of ASCII letters, or one other character). Units begin at bytes, results
speak of code points. A sparse index of exceptions converts the two: it records only where the multibyte
characters lie and how many bytes they have above one, so a text in ASCII has an empty index and its
conversion is the identity; elsewhere ``searchsorted`` finds the excess before a place.

Long texts are scanned in pieces, so memory beside the text follows the piece and the multibyte characters.

Cases: a null text is empty; an empty text, or one that holds a marker, stays plain; a null key is an empty
key; repeated rows are drawn alike, by their key; other columns are carried along by name, whatever the name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import words
from factorloom.llm.carried import map_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
CUT_PERCENT = 90  # of the texts are cut
SPM_PERCENT = 20  # of those have the suffix first
PIECE = 1 << 21

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


class ExceptionIndex:
    """Multibyte characters of some UTF-8 bytes: their places and the excess bytes up to them."""

    def __init__(self, data: np.ndarray):
        heads = np.flatnonzero(data >= 0xC0)
        sizes = data[heads]
        excess = 1 + (sizes >= 0xE0).astype(np.int64) + (sizes >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.bytes = heads
        self.chars = heads - self.excess[:-1]

    def to_chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before byte places that begin a character, or end the text."""
        return places - self.excess[np.searchsorted(self.bytes, places)]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes before code points."""
        return places + self.excess[np.searchsorted(self.chars, places)]


class Units:
    """Where units begin in the texts of a block, by pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, piece: int = PIECE):
        self.data, self.piece = data, piece
        self.heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        self.held: tuple[int, np.ndarray] | None = None
        counts = [len(self._starts(i)) for i in range(-(-len(data) // piece))]
        self.counts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _starts(self, number: int) -> np.ndarray:
        """Places inside a piece; the last piece asked for is held."""
        if self.held and self.held[0] == number:
            return self.held[1]
        first = number * self.piece
        part = self.data[first : first + self.piece]
        letter = LETTERS[part]
        start = (part & 0xC0) != 0x80
        start[1:] &= ~(letter[1:] & letter[:-1])
        if first:
            start[0] &= not (letter[0] and LETTERS[self.data[first - 1]])
        inside = self.heads[(self.heads >= first) & (self.heads < first + len(part))]
        start[inside - first] = True
        self.held = number, np.flatnonzero(start)
        return self.held[1]

    def before(self, places: np.ndarray) -> np.ndarray:
        """Units that begin before each byte place."""
        found = np.empty(len(places), np.int64)
        pieces = np.minimum(places // self.piece, max(len(self.counts) - 2, 0))
        for number in np.unique(pieces) if len(self.data) else ():
            here = pieces == number
            inside = np.searchsorted(self._starts(number), places[here] - number * self.piece)
            found[here] = self.counts[number] + inside
        return found if len(self.data) else np.zeros(len(places), np.int64)

    def place(self, units: np.ndarray) -> np.ndarray:
        """The byte at which each unit begins; one past the last unit is the end."""
        found = np.full(len(units), len(self.data), np.int64)
        pieces = np.searchsorted(self.counts, units, "right") - 1
        for number in np.unique(pieces[units < self.counts[-1]]):
            here = pieces == number
            found[here] = self._starts(number)[units[here] - self.counts[number]] + number * self.piece
        return found


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each text, and for its two drawn cuts the bytes (from the block's start) and code points."""
    units = Units(data, offsets)
    first = units.before(offsets[:-1])
    n = units.before(offsets[1:]) - first
    drawn = np.sort(draws % (n[:, None] + 1), axis=1)
    inside = units.place((first[:, None] + drawn).ravel()).reshape(-1, 2)
    places = np.where(drawn < n[:, None], inside, offsets[1:, None])
    index = ExceptionIndex(data)
    chars = index.to_chars(places.ravel()).reshape(-1, 2) - index.to_chars(offsets[:-1])[:, None]
    return n, places, chars


def arranged(prefix: bytes, middle: bytes, suffix: bytes, suffix_first: bool) -> bytes:
    p, s, m = (x.encode() for x in MARKS)
    parts = (s, suffix, p, prefix, m, middle) if suffix_first else (p, prefix, s, suffix, m, middle)
    return b"".join(parts)


def _block(texts: pa.Array, draws: np.ndarray, cut: np.ndarray, suffix_first: np.ndarray) -> list[pa.Array]:
    data, offsets = words.buffers(texts)
    n, places, chars = cuts(data, offsets, draws)
    marked = np.zeros(len(texts), bool)
    for mark in MARKS:
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = ~cut | (n == 0) | marked
    forms = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    raw, out = memoryview(data), []
    for i, (a, b) in enumerate(places.tolist()):
        first, last = int(offsets[i]), int(offsets[i + 1])
        if plain[i]:
            out.append(bytes(raw[first:last]))
        else:
            out.append(arranged(bytes(raw[first:a]), bytes(raw[a:b]), bytes(raw[b:last]), suffix_first[i]))
    lengths = (chars[:, 0], chars[:, 1] - chars[:, 0])
    return [
        pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()),
        *[pa.array(x, pa.int64(), mask=plain) for x in lengths],
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


def _function(cut_percent: int, spm_percent: int):
    def run(batch: pa.RecordBatch) -> Iterator[tuple[int, list[pa.Array]]]:
        texts = batch.column("text")
        h = [batch.column(f"h{i}").to_numpy() for i in range(4)]
        for first, last, *_ in words.blocks(texts):
            own = slice(first, last)
            draws = np.stack([h[0][own], h[1][own]], axis=1)
            found = _block(
                texts.slice(first, last - first), draws, h[2][own] % 100 < cut_percent, h[3][own] % 100 < spm_percent
            )
            yield last - first, found

    return run


def draws_of(key: Column, seed: str = "1:") -> dict[str, Column]:
    """Four unsigned numbers from the digest of a seed and the key as text."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return {f"h{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}


def fill_in_middle(
    docs: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    key: str = "doc_id",
    cut_percent: int = CUT_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """The ``carry`` columns with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    inputs = {"text": F.coalesce("text", F.lit("")), **draws_of(F.col(key))}
    outputs = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
    return map_texts(docs, carry, inputs, lambda: _function(cut_percent, spm_percent), outputs)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. Its parts hold no marker, so the first of each kind is the one put there."""
    size = len(PREFIX)
    p, s, m = (F.instr(output, mark) for mark in MARKS)
    between = lambda a, b: F.substring(output, a + size, b - a - size)
    middle = F.substring(output, m + size, F.length(output))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def sql() -> str:
    """The contract's digests, with plain lists of units."""
    return r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
    FROM documents
), numbered AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM drawn
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbered
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
           array_to_string(units[b + 1:], '') AS s
    FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
