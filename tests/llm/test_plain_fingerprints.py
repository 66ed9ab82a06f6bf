"""Every column of the fingerprints against a plain version, on odd cases and many ranges of ids."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
import xxhash

from factorloom.llm import fingerprints

LEAST = -(2**63)


def sketch(text: str) -> list[int]:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found = set()
    for i in range(max(len(words) - fingerprints.WORDS + 1, 1) if words else 0):
        value = 42
        for word in words[i : i + fingerprints.WORDS]:
            value = xxhash.xxh64_intdigest(word.encode(), seed=value)
        found.add(value - 2**64 if value >= 2**63 else value)
    return sorted(found)[: fingerprints.K]


def likeness(one: list[int], other: list[int]) -> float:
    union = sorted({*one, *other})[: fingerprints.K]
    return len({*one} & {*other} & {*union}) / len(union) if union else 1.0


def written(values: list[int]) -> str:
    return "".join(f"{v % 2**64:016X}" for v in values)


def plain(rows: list[tuple]) -> Counter:
    texts = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-(LEAST if r[0] is None else r[0]), r[1].encode()))
    out = Counter()
    for (i, text), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, edited, after = sketch(text), sketch(changed), sketch(following)
        out[(
            i, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(own), written(edited),
            round(likeness(own, edited), 12), round(likeness(own, after), 12),
        )] += 1
    return out


@pytest.mark.parametrize("range_rows", [4, 200])
def test_fingerprints_against_a_plain_version(docs, rows, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    found = fingerprints.fingerprint_documents(docs).collect()
    got = Counter(
        (r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
         round(r["near_edited"], 12), round(r["near_next"], 12))
        for r in found
    )
    assert got == plain(rows)
