"""SentencePiece encoding and decoding with a table of distinct chunks.

In the model's vocabulary no piece holds a marker after another character, and none holds a
line break. Merges therefore never cross such a place: a text falls into chunks (markers
followed by other characters, or a line break) whose ids do not depend on their
neighbours. Each distinct chunk is segmented once by the library, and a document's ids are its chunks' ids
joined back by position. The table lives in a task and is emptied when it holds ``TABLE``
chunks, which bounds memory and does not change a result.

Cases: a null or empty text has no ids, and decodes to an empty text; repeated rows are encoded one by
one; a text without any space is one long chunk; other columns are carried along by ``encode``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import words

MARK = "▁"
TABLE = 400_000
BLOCK = 1 << 18  # bytes of text encoded at a time: what a task holds beside its table follows it
LINE, SPACE = 0x0A, 0x20


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def chunks_are_free(model: bytes) -> bool:
    """Whether the vocabulary keeps chunks apart and texts reach the merges unchanged."""
    pieces = load(model)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    crossing = re.compile(rf"[^{MARK}]{MARK}|.\n|\n.", re.DOTALL)
    probe = "a  b ﬁ Ａ é\t\r\n x "
    same = pieces.decode(pieces.encode(probe)) == probe
    return same and not any(crossing.search(n) for n in names if not re.fullmatch(r"<.*>", n))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs one after the other: each start and the ``size - 1`` places after it."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def ends_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Runs:
    """Runs of values of different sizes in one array; more can be added."""

    def __init__(self, kind):
        self.values = np.zeros(0, kind)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.values) + ends_of(sizes)[:-1]
        self.starts = np.concatenate([self.starts, first])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.values = np.concatenate([self.values, values.astype(self.values.dtype)])

    def take(self, slots: np.ndarray) -> np.ndarray:
        return self.values[ragged(self.starts[slots], self.sizes[slots])]


class ChunkTable:
    """Ids of the distinct chunks met so far, found by a hash of their bytes."""

    def __init__(self, model: bytes, most: int = TABLE):
        self.pieces, self.most = load(model), most
        self.line = self.pieces.encode("\n")[-1]
        numbers = [f"{i},".encode() for i in range(self.pieces.get_piece_size())]
        self.labels = Runs(np.uint8)
        self.labels.add(np.frombuffer(b"".join(numbers), np.uint8), np.array([len(x) for x in numbers]))
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.ids = Runs(np.uint8), Runs(np.int32)

    def _segment(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of new chunks, segmented by one call: line breaks stay apart, so one is put before each chunk."""
        line = (sizes == 1) & (data[starts] == LINE)
        order = np.argsort(line, kind="stable")  # a line break is its own chunk, and goes last
        starts, sizes = starts[order], sizes[order]
        raw = data[ragged(starts, sizes)]
        slots = np.empty(len(order), np.int64)
        slots[order] = len(self.ids.sizes) + np.arange(len(order))
        self.bytes.add(raw, sizes)
        plain = len(order) - int(line.sum())
        joined = np.full(int(sizes[:plain].sum()) + plain, LINE, np.uint8)
        joined[ragged(ends_of(sizes[:plain] + 1)[:-1] + 1, sizes[:plain])] = raw[: int(sizes[:plain].sum())]
        # the library puts a marker before the whole text, so ids before the first break are dropped
        flat = np.asarray(self.pieces.encode(joined.tobytes().decode()), np.int32)
        breaks = np.flatnonzero(flat == self.line)
        counts = np.diff(np.append(breaks, len(flat))) - 1
        ids = flat[breaks[0] :][flat[breaks[0] :] != self.line] if plain else flat[:0]
        lines = len(order) - plain
        self.ids.add(np.append(ids, [self.line] * lines), np.append(counts, [1] * lines).astype(np.int64))
        return slots

    def _add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(keys)
        self.keys, self.slots = keys[order], slots[order]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each chunk; new chunks are segmented first."""
        found = words.hashes(data, starts, ends, fold=False)
        keys, first, place = np.unique(found, return_index=True, return_inverse=True)
        new = ~self._known(keys)
        if len(self.keys) + new.sum() > self.most:
            self.clear()
            new[:] = True
        if new.any():
            where = first[new]
            self._add(keys[new], self._segment(data, starts[where], ends[where] - starts[where]))
        slots = self.slots[np.searchsorted(self.keys, keys)][place]
        odd = self._unlike(slots, data, starts, ends)
        if len(odd):  # another chunk has the hash: these are segmented apart
            slots[odd] = self._segment(data, starts[odd], ends[odd] - starts[odd])
        return slots

    def _unlike(self, slots: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Chunks whose bytes are not those of their slot; the chunks make up ``data``."""
        if np.array_equal(self.bytes.take(slots), data):
            return np.zeros(0, np.int64)
        at, sizes = self.bytes.starts[slots], self.bytes.sizes[slots]
        values = self.bytes.values
        same = [
            n == b - a and np.array_equal(values[p : p + n], data[a:b])
            for p, n, a, b in zip(at.tolist(), sizes.tolist(), starts.tolist(), ends.tolist())
        ]
        return np.flatnonzero(~np.array(same))


def chunk_bounds(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of texts that begin at ``heads``: markers and what follows them, or a line break."""
    new = data == LINE
    new[1:] |= data[:-1] == LINE
    new[1:] |= (data[1:] == SPACE) & (data[:-1] != SPACE)
    new[heads] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(data))


@dataclass
class Encoded:
    """Ids of some texts one after the other, the same as decimal numbers with commas, and where texts end."""

    ids: np.ndarray
    id_ends: np.ndarray
    labels: np.ndarray
    label_ends: np.ndarray


def encode_block(texts: list[str], table: ChunkTable) -> Encoded:
    """Encode some texts; empty ones have no ids."""
    parts = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    offsets = ends_of(sizes)
    data = np.frombuffer(b"".join(parts), np.uint8)
    if not len(data):
        none = np.zeros(len(texts) + 1, np.int64)
        return Encoded(np.zeros(0, np.int32), none, np.zeros(0, np.uint8), none)
    starts, ends = chunk_bounds(data, offsets[:-1][sizes > 0])
    slots = table.find(data, starts, ends)
    ids = table.ids.take(slots)
    id_ends = ends_of(table.ids.sizes[slots])[np.searchsorted(starts, offsets)]
    return Encoded(ids, id_ends, table.labels.take(ids), ends_of(table.labels.sizes[ids])[id_ends])


def text_blocks(texts: list[str], most: int = words.BLOCK) -> Iterator[list[str]]:
    """Texts in groups of about ``most`` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _encoder(model: bytes, carried: int, with_ids: bool):
    names = [f"__c{i}" for i in range(carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for first, last, *_ in words.blocks(batch.column("__text"), BLOCK):
                own = batch.slice(first, last - first)
                texts = [t or "" for t in own.column("__text").to_pylist()]
                found = encode_block(texts, table)
                raw, ids, ends = found.labels.tobytes(), found.ids.tolist(), found.id_ends
                labels = [
                    _digest(raw[a : b - 1] if b > a else b"")
                    for a, b in zip(found.label_ends, found.label_ends[1:])
                ]
                decoded = [
                    _digest(table.pieces.decode(ids[a:b]).encode() if b > a else b"")
                    for a, b in zip(ends, ends[1:])
                ]
                columns = [own.column(n) for n in names]
                columns += [pa.array(np.diff(ends)), pa.array(labels), pa.array(decoded)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ids)))
                all_names = [*names, "__n", "__ids_sha", "__text_sha", "__ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, all_names)

    return run


def encode(docs: DataFrame, model: bytes, carry: list[str], with_ids: bool = False) -> DataFrame:
    """The ``carry`` columns of ``docs`` with n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    if not chunks_are_free(model):
        raise ValueError("pieces of this vocabulary cross chunk borders, or texts are normalised")
    rows = docs.select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col("text").alias("__text")
    )
    kinds = {f"__c{i}": rows.schema[f"__c{i}"].dataType.simpleString() for i in range(len(carry))}
    kinds |= {"__n": "bigint", "__ids_sha": "string", "__text_sha": "string"}
    names = dict(zip(kinds, [*carry, "n_tokens", "ids_sha256", "decoded_sha256"], strict=True))
    if with_ids:
        kinds["__ids"], names["__ids"] = "array<int>", "ids"
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items())
    found = rows.mapInArrow(_encoder(model, len(carry), with_ids), schema)
    return found.select(*[F.col(n).alias(to) for n, to in names.items()])


class _Decoder:
    """Loads the model once in each worker."""

    def __init__(self, model: bytes):
        self.model, self.pieces = model, None

    def __getstate__(self):
        return {"model": self.model, "pieces": None}

    def text(self, ids: list[int] | None) -> str:
        self.pieces = self.pieces or load(self.model)
        return self.pieces.decode(ids) if ids else ""


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with the texts of its ids as ``decoded``; null ids give an empty text."""
    decoder = _Decoder(model)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([decoder.text(x) for x in column.to_pylist()], pa.string())

    return encoded.withColumn("decoded", text(F.col(ids)))
