"""Columns that travel beside a text through an Arrow function, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
Rows = Callable[[pa.RecordBatch], Iterator[tuple[int, Sequence[pa.Array]]]]


def map_texts(
    docs: DataFrame, carry: Sequence[str], inputs: dict[str, Column], make: Callable[[], Rows], outputs: dict[str, str]
) -> DataFrame:
    """The ``carry`` columns of ``docs`` and new ones that an Arrow function makes from ``inputs``.

    ``make`` is called once in a task; what it gives takes a batch of the inputs and yields (rows, arrays of
    ``outputs``) for consecutive rows. Carried columns have numbers for names on the way, so they cannot clash.
    """
    held = {f"__c{i}": c for i, c in enumerate(carry)}
    rows = docs.select(*[F.col(c).alias(n) for n, c in held.items()], *[c.alias(n) for n, c in inputs.items()])
    made = {f"__o{i}": kind for i, kind in enumerate(outputs.values())}

    def run(batches: Batches) -> Batches:
        function = make()
        for batch in batches:
            first = 0
            for count, arrays in function(batch):
                own = batch.slice(first, count)
                first += count
                yield pa.RecordBatch.from_arrays([*[own.column(n) for n in held], *arrays], [*held, *made])

    kinds = {n: rows.schema[n].dataType.simpleString() for n in held} | made
    found = rows.mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in kinds.items()))
    return found.select(
        *[F.col(n).alias(c) for n, c in held.items()], *[F.col(n).alias(o) for n, o in zip(made, outputs)]
    )
