"""Text columns as numpy byte buffers inside Arrow batches.

The operators of this subpackage look at texts as UTF-8 bytes: words are runs
of bytes other than 0x20 and 0x09-0x0D, and only A-Z are lower-cased, so no
decoding is needed and every step runs on whole batches.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 1 << 20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null
    counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(offsets) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer text is one
    range by itself."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def per_text(df: DataFrame, text_col: str, keep: list[str], fields: list[StructField],
             fn: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """``keep`` columns plus the columns that ``fn(bytes, offsets)`` computes
    for each row (one array per field), narrow and in input order."""
    schema = StructType([f for f in df.schema.fields if f.name in keep])
    schema = StructType([schema[c] for c in keep] + fields)
    source = df.select(*[f"`{c}`" for c in keep], df[f"`{text_col}`"].alias("__text"))

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(len(keep)))
            for a, b in slices(off):
                part = batch.slice(a, b - a)
                made = fn(buf[off[a]:off[b]], off[a:b + 1] - off[a])
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in made],
                    names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
