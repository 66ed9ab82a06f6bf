"""Token counts of texts by a two-tier lookup of word lengths, without a shuffle of words.

For a tokenizer that drops white space and never looks across it, a text's count is the sum of its words'
counts. A table of frequent words and their counts goes to all workers once; words it misses are encoded by
the library, each distinct one once, and kept in a cache of the worker. The table comes from
the first ``SAMPLE_ROWS`` rows of every task and holds at most ``TABLE_WORDS`` words; it decides how often the library
is called and never what a word counts, so results do not depend on it. The cache falls
back to the table when it holds ``CACHE_WORDS`` words, and words above ``LONG`` bytes are never kept, so memory is bounded.

Cases: a null or empty text has no tokens; repeated rows are counted one by one; a text without white space is one word;
special strings inside a text count as the library counts them, since white space around them changes nothing and
the words that hold them reach the library whole; other columns are carried along by name, whatever the name.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.carried import map_texts
from factorloom.llm.splitting import byte_blocks, word_lists

SAMPLE_ROWS = 200  # of each task
TASK_WORDS = 4_000
TABLE_WORDS = 1 << 16
CACHE_WORDS = 1 << 19
LONG = 64


def load(tokenizer: str):
    """The library's tokenizer from its JSON text, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(tokenizer)
    found.no_truncation()
    found.no_padding()
    return found


def lengths(tokenizer, texts: Sequence[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]


def words_are_free(tokenizer: str) -> bool:
    """Whether white space yields no tokens and no token can depend on what lies beyond it."""
    added = json.loads(tokenizer).get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 for t in added):
        return False
    found = load(tokenizer)
    parts = ["it's", "e", "́x", "Á", "12", "<b>", "İΣ", "日本", "'", "s", *[t["content"] for t in added]]
    alone = sum(lengths(found, parts))
    return all(
        lengths(found, [gap + gap.join(parts) + gap, gap * 3]) == [alone, 0]
        for gap in (" ", "\t", "\n", "\x0b", "\x0c", "\r", " \r\n ")
    )


class WordLengths:
    """Tokens of words: the table's, then the cache's, then the library's."""

    def __init__(self, tokenizer: str, table: dict[bytes, int], most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.table, self.most = load(tokenizer), table, most
        self.known = dict(table)
        self.encoded = 0

    def counts(self, texts: Sequence[bytes]) -> list[int]:
        """Tokens of each text; the texts of a block learn their words by one call."""
        if len(texts) == 1:
            return [sum(self._count([found])[0] for found in word_lists(texts[0]))]
        return self._count([t.split() for t in texts])

    def _count(self, lists: Sequence[list[bytes]]) -> list[int]:
        new = set().union(*lists).difference(self.known)
        if len(self.known) + len(new) > self.most + len(self.table):
            self.known = dict(self.table)
            new = set().union(*lists).difference(self.known)
        if new:
            self.encoded += len(new)
            self.known.update(zip(new, lengths(self.tokenizer, [w.decode() for w in new])))
        totals = [sum(map(self.known.__getitem__, found)) for found in lists]
        for word in new:
            if len(word) > LONG:
                del self.known[word]
        return totals


def _first_words(rows: int, most: int):
    """The words a task meets most often in its first rows; it reads no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()
        for batch in itertools.islice(batches, 1):
            for texts in byte_blocks(batch.column("text").slice(0, rows)):
                for raw in texts:
                    for found in word_lists(raw):
                        counted.update(found)
        top = [(w.decode(), n) for w, n in counted.most_common(most) if len(w) <= LONG]
        if top:
            columns = [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    return run


def frequent_words(
    docs: DataFrame, tokenizer: str, rows: int = SAMPLE_ROWS, each: int = TASK_WORDS, most: int = TABLE_WORDS
) -> dict[bytes, int]:
    """Frequent words with their tokens, at most ``most`` of ``LONG`` bytes: of the first ``rows`` rows of each task the
    ``each`` most frequent ones, added up. What is shuffled follows the number of tasks."""
    counted = docs.select("text").mapInArrow(_first_words(rows, each), "word string, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")
    found = top.toArrow()["word"].to_pylist()
    return {w.encode(): n for w, n in zip(found, lengths(load(tokenizer), found))}


_WORKER: dict[str, WordLengths] = {}


def in_worker(tokenizer: str, found: bytes, counts: bytes) -> WordLengths:
    """The worker's own lengths; later tasks of a worker that is used again find what earlier ones learned."""
    key = hashlib.sha256(b"\0".join([tokenizer.encode(), found, counts])).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordLengths(tokenizer, dict(zip(found.split(b"\n"), counts)) if counts else {})
    return _WORKER[key]


def count_tokens(docs: DataFrame, tokenizer: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with ``n_bytes`` and ``n_tokens``; ``tokenizer`` is the library's JSON text."""
    if not words_are_free(tokenizer):
        raise ValueError("tokens of this tokenizer depend on white space")
    table = frequent_words(docs, tokenizer)
    # one line a word and one byte a count; a worker makes its hash table from it once
    compact = b"\n".join(table), bytes(table.values())
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, *compact))

    def make():
        known = in_worker(*shared.value)

        def run(batch: pa.RecordBatch) -> Iterator[tuple[int, list[pa.Array]]]:
            for texts in byte_blocks(batch.column("text")):
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield len(texts), [sizes, pa.array(known.counts(texts), pa.int64())]

        return run

    return map_texts(docs, carry, {"text": F.col("text")}, make, {"n_bytes": "bigint", "n_tokens": "bigint"})
