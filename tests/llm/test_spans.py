"""Fill-in-middle, runs of words and token counts against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorloom.llm import middles, periods, queries, token_counts
from tests.compare import differences
from tests.llm.conftest import CLASHING, DOCS

ODD = [
    (400, "<P>marked"), (401, "a<S>b"), (402, "end<M"), (403, "<<S >P>"), (404, "é日本x𝄞yz 日" * 40), (405, "S>ab<"),
    (406, "it's They'LL 'sun \"'s 12ab é́ ́ á b İΣς ﬁ <|endoftext|>x <|ENDOFTEXT|>  z"),
    (407, "<|startoftext|><|endoftext|> |> <|"), (408, "a " * 40), (409, "a b a b a b a b a b c " * 9), (410, "x\x1cy\x85z　w"),
    (411, " ".join(["one two three four five six"] * 3 + ["seven"] * 9)), (412, "ab ab ba " * 5 + "ab ab ba ab"), (413, "क़" * 30),
]


@pytest.fixture(scope="module")
def all_rows(rows):
    more = [(i, t, "en", None, len(t), *CLASHING) for i, t in ODD]
    rng = random.Random(3)
    for i in range(500, 640):  # few words, so that runs and chance repeats abound
        text = " ".join(rng.choice("abc"[: 1 + i % 3]) for _ in range(rng.randint(0, 60)))
        more.append((i, text * (1 + i % 4), "en", "s", 1, *CLASHING))
    return [*rows, *more]


@pytest.fixture(scope="module")
def folder(spark, all_rows, tmp_path_factory):
    """The rows as the documents table of a folder."""
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame(all_rows, DOCS).repartition(3)
    frame.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty_folder(nothing, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    nothing.write.parquet(f"{path}/documents.parquet")
    return str(path)


def parts_as_views(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return con


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def same_rows(found, expected) -> None:
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


# ---- 11: fill-in-middle ----------------------------------------------------------------------


def plain_middle(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_against_a_plain_version(spark, all_rows, folder):
    expected = [plain_middle(r[0], r[1]) for r in all_rows]
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    found = middles.fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"))
    same_rows(found.collect(), expected)
    digests = [(*e[:5], sha(e[5]), sha(r[1] or "")) for e, r in zip(expected, all_rows)]
    same_rows(queries.fill_in_middle(spark, folder).collect(), digests)


def test_middles_against_sql(spark, folder):
    assert differences(queries.fill_in_middle(spark, folder), parts_as_views(folder), middles.sql()) is None


def test_middles_of_nothing(spark, empty_folder, nothing):
    assert queries.fill_in_middle(spark, empty_folder).collect() == []
    carried = middles.fill_in_middle(nothing, carry=["key", "size", "kept", "doc_id"])
    assert carried.columns == ["key", "size", "kept", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\n é日𝄞", max_size=30), st.integers(1, 9))
def test_units_and_index_in_small_pieces(text, piece):
    data = np.frombuffer(text.encode(), np.uint8)
    index = middles.ExceptionIndex(data)
    places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == places.tolist()
    assert index.to_chars(places).tolist() == list(range(len(text) + 1))
    units = middles.Units(data, np.array([0, len(data)]), piece)
    found = [len(text[: m.start()].encode()) for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    assert units.place(np.arange(len(found) + 1)).tolist() == [*found, len(data)]
    assert units.before(np.array([0, len(data)])).tolist() == [0, len(found)]


def test_index_of_ascii_is_empty():
    assert len(middles.ExceptionIndex(np.frombuffer(b"plain text" * 99, np.uint8)).bytes) == 0


def test_markers_that_cuts_could_form():
    """Parts that end or begin like a marker do not hide the ones between them."""
    for form in (False, True):
        for parts in (("<S", "<M", "P>"), ("<", "S>", ">"), ("", "", "<P"), ("<P<S", ">", "M>")):
            out = middles.arranged(*[p.encode() for p in parts], form).decode()
            cut = [out.index(m) for m in middles.MARKS]
            names = dict(zip("psm", cut))
            ends = sorted([*cut, len(out)])
            got = {k: out[v + 3 : ends[ends.index(v) + 1]] for k, v in names.items()}
            assert (got["p"], got["m"], got["s"]) == parts


# ---- 12: runs --------------------------------------------------------------------------------


def plain_runs(words):
    """Every maximal stretch with a smallest period, by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            # a multiple of a period keeps the stretch: only the smallest counts
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_run_row(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return key, len(runs), *best, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_against_a_plain_version(spark, all_rows, folder):
    short = [r for r in all_rows if len(r[1] or "") < 20_000]
    expected = [plain_run_row(r[0], r[1]) for r in short]
    assert sum(r[1] > 1 for r in expected) > 20
    found = queries.find_runs(spark, folder).filter(~F.col("doc_id").isin(310, 311) | F.col("doc_id").isNull())
    same_rows(found.collect(), expected)


def test_runs_of_nothing(spark, empty_folder, nothing):
    assert queries.find_runs(spark, empty_folder).collect() == []
    carried = periods.find_runs(nothing, carry=["kept", "key"])
    assert carried.columns == ["kept", "key", "n_words", "runs", "strongest", "collapsed"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_runs_of_blocks(texts):
    found = periods.runs_of([np.array(t, np.int64) for t in texts])
    assert found == [plain_runs(t) for t in texts]


def test_runs_of_long_texts():
    one = np.zeros(60_000, np.int64)
    two = np.tile(np.arange(7), 9_000)
    unlike = np.arange(50_000)
    want = [[(0, 60_000, 1)], [(0, 63_000, 7)], []]
    assert periods.runs_of([one, two, unlike]) == want


# ---- 13: token counts ------------------------------------------------------------------------


PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def test_counts_equal_the_library(spark, all_rows, folder):
    own = library()
    expected = []
    for r in all_rows:
        n = len(own.encode(r[1] or "", add_special_tokens=False).ids)
        expected.append((r[0], len((r[1] or "").encode()), n, n > 2048))
    assert any(r[3] for r in expected)
    same_rows(queries.count_tokens(spark, folder).collect(), expected)


def test_counts_of_nothing(spark, empty_folder, nothing):
    assert queries.count_tokens(spark, empty_folder).collect() == []
    with open(PATH) as file:
        carried = token_counts.count_tokens(nothing, file.read(), carry=["key", "kept"])
    assert carried.columns == ["key", "kept", "n_bytes", "n_tokens"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_counts_of_any_text(text):
    table = token_counts.WordLengths(OWN, {b"the": 1})
    assert table.counts([text.encode(), b"the"])[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


with open(PATH) as _file:
    OWN = _file.read()
LIBRARY = library()


def test_a_full_cache_falls_back_to_the_table():
    table = token_counts.WordLengths(OWN, {b"the": 1}, most=5)
    texts = [f"the word{i} Word{i} the".encode() for i in range(30)]
    want = [len(LIBRARY.encode(t.decode(), add_special_tokens=False).ids) for t in texts]
    assert [table.counts([t, b""])[0] for t in texts] == want
    assert len(table.known) <= 6
    assert table.counts([b"x" * 5000]) == [len(LIBRARY.encode("x" * 5000, add_special_tokens=False).ids)]
    assert b"x" * 5000 not in table.known


def test_a_word_is_encoded_once():
    table = token_counts.WordLengths(OWN, {b"the": 1})
    table.counts([b"the cat sat", b"the cat"])
    table.counts([b"cat sat the"])
    assert table.encoded == 2
