"""Tables of packed numbers: rows that hold many values as bytes, dealt to
parts by the values, and bounded bit filters made from them."""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import mix

MAX_BITS = 1 << 28  # bits of the largest filter (32 MB)


def pack(part: np.ndarray, columns: dict[str, np.ndarray], **fixed) -> pa.RecordBatch:
    """One row per part number, in which every column's values are bytes; the
    values of a part keep their order.  ``fixed`` values go to every row."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(part))
    names = ["part", *fixed, *columns]
    arrays = [pa.array(part[cuts].astype(np.int32))]
    arrays += [pa.array(np.full(len(cuts), v)) for v in fixed.values()]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        width = values.nbytes // max(1, len(values))
        raw = memoryview(values).cast("B") if len(values) else b""
        arrays.append(pa.array([bytes(raw[a * width:b * width]) for a, b in zip(cuts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """For runs of rows with equal ``keys`` (rows sorted by them) the values
    of each of ``names``, as lists."""
    held, key = [[] for _ in names], None
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in keys])):
            if k != key:
                if key is not None:
                    yield key, held
                key, held = k, [[] for _ in names]
            for h, c in zip(held, columns):
                h.append(c[i].as_py())
    if key is not None:
        yield key, held


def joined(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _spots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.uint64))
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def bit_filter(keys: DataFrame, column: str = "key") -> np.ndarray:
    """A Bloom filter of a column of longs as 64-bit words: two bits a key and
    about 16 bits of room for each, up to ``MAX_BITS``; with more keys it lets
    more values pass and never loses one."""
    n = keys.count()
    bits = min(MAX_BITS, 1 << max(10, math.ceil(math.log2(max(1, n) * 16))))

    def mark(batches):
        for batch in batches:
            spots = np.unique(np.concatenate(_spots(batch.column(0).to_numpy(), bits)))
            words, at = np.unique(spots >> 6, return_index=True)
            if len(words):
                values = np.bitwise_or.reduceat(np.uint64(1) << (spots & 63).astype(np.uint64), at)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.astype(np.int64))],
                                                 names=["w", "v"])

    marked = (keys.select(column).mapInArrow(mark, "w long, v long")
              .groupBy("w").agg(F.bit_or("v").alias("v")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[marked.column(0).to_numpy()] = marked.column(1).to_numpy()
    return table


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    hit = np.ones(len(keys), bool)
    for at in _spots(keys, len(table) * 64):
        hit &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return hit
