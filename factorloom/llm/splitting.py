"""Words of texts as byte strings, a piece of a text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from factorloom.llm import words

GAP = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20


def word_lists(raw: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words between ASCII white space, in lists from pieces of about ``most`` bytes."""
    first = 0
    while first < len(raw):
        gap = GAP.search(raw, first + most)
        last = gap.start() if gap else len(raw)
        yield raw[first:last].split()  # bytes split at these six characters and no others
        first = last


def byte_blocks(texts: pa.Array, most: int = words.BLOCK) -> Iterator[list[bytes]]:
    """Runs of consecutive texts of about ``most`` bytes, in UTF-8; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    for first, last, *_ in words.blocks(texts, most):
        yield texts.slice(first, last - first).to_pylist()
