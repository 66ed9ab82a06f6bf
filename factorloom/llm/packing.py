"""Arrays that travel to group tasks as packed columns: one row for each block and group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def packed(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array.astype(kind)).tobytes()


def planes(array: np.ndarray, kind: str) -> bytes:
    """All first bytes, then all second ones and so on: of small numbers most are zeros in a row, which compress."""
    array = np.ascontiguousarray(array.astype(kind))
    return array.view(np.uint8).reshape(len(array), -1).T.tobytes() if len(array) else b""


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    columns = [pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names)


def in_round(values: np.ndarray, number: int, rounds: int) -> np.ndarray:
    return (values >> U64(56)) % U64(rounds) == U64(number)


def group_of(values: np.ndarray, groups: int) -> np.ndarray:
    return (((values & U64(0xFFFFFFFF)) * U64(groups)) >> U64(32)).astype(np.int64)


def parts_of(group: np.ndarray):
    """Each group's number and its places, in order."""
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    for part in np.split(order, np.flatnonzero(np.diff(ordered)) + 1):
        yield int(group[part[0]]), part


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new class begins among ordered entries."""
    new = np.ones(len(columns[0]), bool)
    for values in columns:
        if len(values):
            new[1:] &= values[1:] == values[:-1]
    new[1:] = ~new[1:]
    return np.flatnonzero(new)


def spread(values: np.ndarray, heads: np.ndarray, size: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(heads, size)))


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def joined_planes(table: pa.Table, name: str, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(x, np.uint8).reshape(width, -1).T for x in table[name].to_pylist()]
    return np.concatenate(parts).reshape(-1).view(kind) if parts else np.zeros(0, kind)


def numbers(table: pa.Table, name: str, read=joined) -> np.ndarray:
    """Numbers of documents inside each row, as numbers in all rows' documents."""
    counts = [len(x) // 8 for x in table["ids"].to_pylist()]
    each = [len(x) // 4 for x in table[name].to_pylist()]
    return read(table, name, "<u4").astype(np.int64) + np.repeat(np.cumsum([0, *counts])[:-1], each)
