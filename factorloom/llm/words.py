"""Words and bytes of many texts at once, as numpy arrays over an Arrow column.

Texts are handled in blocks of a few megabytes, so memory follows the block and not the batch; a
longer text is a block of its own.

Cases: a null text is empty, and an empty or blank one has no words; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK = 1 << 21
LONG_WORD = 512
PIECE = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# everything in ASCII but letters and digits
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# the first bytes of eight, by their number
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_random = np.random.default_rng(20240229)
_BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15)
_UNBASE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    found = np.full(n, base, U64)
    found[0] = 1
    return np.multiply.accumulate(found)


_POWERS, _INVERSES = _powers(_BASE, PIECE), _powers(_UNBASE, PIECE)


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    values = (values ^ (values >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> U64(29))) * U64(0x94D049BB133111EB)
    return values ^ (values >> U64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, row after the last, bytes, offsets."""
    data, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def bounds(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a word never crosses a text's end."""
    inside = ~gaps[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[tails] = inside[tails]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def _hash_piece(data, starts, ends, table) -> np.ndarray:
    low, size = starts[0], int(ends[-1] - starts[0])
    powers, inverses = _POWERS, _INVERSES
    if size > PIECE:
        powers, inverses = _powers(_BASE, size), _powers(_UNBASE, size)
    sums = np.zeros(size + 1, U64)
    np.cumsum(table[data[low : low + size]] * powers[:size], out=sums[1:])
    return (sums[ends - low] - sums[starts - low]) * inverses[starts - low]


def feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A hash of each word for features of models, from sums over the text. Words can be made that collide, which only
    shares a weight; ``hashes`` is for telling words apart."""
    table = _BYTES[LOWER] if fold else _BYTES
    found = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + PIECE, "right"))
        last = max(last, first + 1)
        found[first:last] = _hash_piece(data, starts[first:last], ends[first:last], table)
        first = last
    return mixed(found)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word, of its lower case in ASCII if ``fold``.

    Words are read eight bytes at a time, each mixed into what came before by multiplications and shifts, so no structure of
    a text makes two words collide; words above ``LONG_WORD`` bytes go through a cryptographic hash.
    """
    data = LOWER[data] if fold else data
    sizes = np.asarray(ends - starts, np.int64)
    found = mixed(sizes.astype(U64) + _BASE)
    # an empty table has no place to read at
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    here = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    step = 0
    while len(here):
        left = sizes[here] - step
        read = eights[starts[here] + step]
        read &= _HEADS[np.minimum(left, 8)]
        found[here] = mixed((found[here] ^ read) * _BASE + U64(step))
        step += 8
        here = here[left > 8]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        found[i] = int.from_bytes(digest, "little")
    return found


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row each place belongs to."""
    return np.searchsorted(offsets, starts, "right") - 1


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word, in order."""
    starts, ends = bounds(data, offsets, gaps)
    return owners(starts, offsets), hashes(data, starts, ends, fold)


def packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
