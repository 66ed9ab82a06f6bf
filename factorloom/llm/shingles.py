"""Sets of hashed word shingles of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from factorloom.llm import words

U64 = np.uint64
_FACTORS = (np.random.default_rng(40).integers(1, 2**63, 64, dtype=np.uint64) << U64(1)) | U64(1)


def _joined(found: np.ndarray, starts: np.ndarray, count: int, size: int) -> np.ndarray:
    """A 63-bit hash of ``count`` words from each start; hashes of other counts differ."""
    total = np.full(len(starts), _FACTORS[-1 - (count if count < size else 0)], U64)
    for i in range(count):
        total += found[starts + i] * _FACTORS[i]
    return words.mixed(total) >> U64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``size`` words.

    Words are lower-cased in ASCII. Fewer words make one shingle, no word an empty set.
    """
    for first, last, data, offsets in words.blocks(column):
        owner, found = words.word_hashes(data, offsets)
        cuts = np.searchsorted(owner, np.arange(last - first + 1))
        runs = _joined(found, np.arange(max(0, len(found) - size + 1)), size, size)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield _joined(found, np.array([a] if b > a else [], np.int64), b - a, size)


def set_fingerprint(values: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    one = words.mixed(values ^ _FACTORS[20]).sum(dtype=U64)
    other = words.mixed(values ^ _FACTORS[21]).sum(dtype=U64)
    return np.array([one, other], U64).tobytes()
