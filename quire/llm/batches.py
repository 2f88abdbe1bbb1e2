"""Arrow-batch helpers for operators whose row work is numpy inside a Spark task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text a task works on at once; a longer row is worked on alone.
TEXT_BYTES = 2 << 20


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row, a null text as no bytes."""
    return [b"" if b is None else b for b in column.cast(pa.binary()).to_pylist()]


def text_slices(column: pa.Array, rows: int = 256, limit: int = TEXT_BYTES // 4) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a column with their texts' bytes, at most some ``limit`` each: no more of a batch
    becomes Python objects at a time."""
    for at in range(0, len(column), rows):
        texts = text_bytes(column.slice(at, rows))
        for a, b in row_slices(texts, limit):
            yield at + a, at + b, texts[a:b]


def row_slices(texts, limit: int = TEXT_BYTES, size=len) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes (or ``size`` units) each, never splitting a row."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + size(t) > limit:
            yield start, i
            start, held = i, 0
        held += size(t)
    if start < len(texts):
        yield start, len(texts)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns (a dict) or None for no rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                if cols is not None:
                    yield pa.RecordBatch.from_pydict(cols)

    return df.mapInArrow(run, schema)


def offsets_of(counts) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row out of a flat array and its row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
