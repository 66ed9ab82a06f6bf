"""Words that collide under sums of powers, and chunks that share a hash: results stay right."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factorloom.llm import lines, neardups, pieces, suffixes, words
from tests.llm.test_texts import same_rows, sha, without_repeats

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIZES = [1024, 2048, 4096]


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def unlike(n: int) -> tuple[str, str]:
    one = thue_morse(n)
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def frame(spark):
    rows, i = [], 0
    for n in SIZES:
        for word in unlike(n):
            rows.append((i, f"x{n} {word} y{n} z{n} w{n}\nother line {i} of this text here"))
            i += 1
    rows += [(90, "other"), (91, None), (92, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), rows


def test_hashes_tell_words_apart():
    for fold in (False, True):
        for n in SIZES:
            data = np.frombuffer("".join(unlike(n)).encode(), np.uint8)
            found = words.hashes(data, np.array([0, n]), np.array([n, 2 * n]), fold)
            assert found[0] != found[1]
    data = np.frombuffer(b"Word word wor d\x00 d ab abcdefgh abcdefghi Abcdefgh", np.uint8)
    starts, ends = words.bounds(data, np.array([0, len(data)]), words.SPACES)
    plain, folded = (words.hashes(data, starts, ends, fold) for fold in (False, True))
    assert len(set(plain.tolist())) == len(plain)
    assert folded[0] == folded[1] and folded[6] == folded[8] and len(set(folded.tolist())) == len(folded) - 2
    assert len(words.hashes(data, starts[:0], ends[:0], True)) == 0


def test_pieces_of_colliding_words(spark, frame):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = pieces.encode(frame[0], pieces.read_model(PATH), ["doc_id"], with_ids=True).collect()
    want = []
    for i, t in frame[1]:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()), ids))
    same_rows([tuple(r) for r in found], want)


def test_chunks_that_share_a_hash_are_segmented_apart(monkeypatch):
    once = words.hashes
    monkeypatch.setattr(words, "hashes", lambda *a, **k: once(*a, **k) % np.uint64(7))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table = pieces.ChunkTable(pieces.read_model(PATH))
    for texts in (["one two three\nfour five  six", "", "seven eight\n\nnine two"], ["two ten\n", "eleven two one"]):
        found = pieces.encode_block(texts, table)
        ids = found.ids.tolist()
        assert [ids[a:b] for a, b in zip(found.id_ends, found.id_ends[1:])] == library.encode(texts)


def test_near_duplicates_of_colliding_words(frame):
    found = neardups.near_duplicates(frame[0], 3, 85).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in found)


def test_lines_of_colliding_words(frame):
    found = lines.remove_similar_lines(frame[0]).filter(F.col("__gone").isNotNull()).collect()
    assert [r["doc_id"] for r in found] == []


def test_repeats_of_colliding_words(frame):
    found = suffixes.remove_repeats(frame[0]).collect()
    same_rows([(*r[:4], bytes(r[4])) for r in found], list(without_repeats(frame[1])))
