"""Texts to columns through Arrow, a few rows at a time.

Ids and other columns that only pass through never leave Arrow, so a null beside them changes
nothing (pandas would make doubles of them), and a worker holds the texts of a small part of a
batch at once, whatever the size of batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes of a part; a longer text is a part of its own.
ROWS, BYTES = 128, 1 << 21


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, in order; none of an empty batch."""
    return slices(batch, ROWS, BYTES)


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, and of so many bytes or one row."""
    n = batch.num_rows
    if n > rows or n > 1 and batch.nbytes > size:
        yield from slices(batch.slice(0, n // 2), rows, size)
        yield from slices(batch.slice(n // 2), rows, size)
    elif n:
        yield batch


def release() -> None:
    """Give freed memory back to the system: idle workers stay beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def with_made(df: DataFrame, kept: list[str], text: str, made: str, work: Callable[[list], list]) -> DataFrame:
    """The columns ``kept`` as they are, then those of the DDL ``made``.

    ``work`` takes the values of the column ``text`` in a list and gives a list for each column; what
    it remembers from part to part it forgets by its attribute ``done``, when a task ends.
    """
    schema, extra = StructType([df.schema[c] for c in kept]), StructType.fromDDL(made)
    types = arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                new = [pa.array(v, t) for v, t in zip(work(part.column(text).to_pylist()), types.types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, [*kept, *types.names])
        if hasattr(work, "done"):
            work.done()
        release()

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, StructType(schema.fields + extra.fields))
