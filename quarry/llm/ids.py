"""Bounded Bloom filters of ids, for scans that should move few rows.

A filter has two bits an id and at most ``FILTER_BITS`` bits; with more ids it
only lets more rows pass.  An exact join always follows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

FILTER_BITS = 1 << 26  # bits of the largest filter (8 MB)


def spot(column: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), column), F.lit(bits))


def id_filter(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """The filter of a column as 64-bit words, and its number of bits."""
    n = ids.count()
    bits = min(FILTER_BITS, 1 << max(10, math.ceil(math.log2(max(1, n) * 16))))
    spots = ids.select(F.explode(F.array(*[spot(F.col(column), i, bits) for i in (0, 1)])).alias("b"))
    words = (spots.groupBy(F.shiftright("b", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return table, bits


def passes(table: np.ndarray, *spots: np.ndarray) -> np.ndarray:
    """Whether each row's bits are all set."""
    hit = np.ones(len(spots[0]), bool)
    for at in spots:
        hit &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return hit


def maybe_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id may be among ``ids`` (one column of that name),
    by the filter alone: all that are and few others; an exact join follows."""
    table, bits = id_filter(ids, id_col)
    data, names = df.sparkSession.sparkContext.broadcast(table), df.columns

    def keep(batches):
        for batch in batches:
            spots = [batch.column(len(batch.columns) - 2 + i).to_numpy() for i in (0, 1)]
            rows = batch.filter(pa.array(passes(data.value, *spots)))
            yield pa.RecordBatch.from_arrays(rows.columns[:-2], names=names)

    spots = {f"__b{i}": spot(F.col(f"`{id_col}`"), i, bits) for i in (0, 1)}
    return df.withColumns(spots).mapInArrow(keep, df.schema)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not among ``ids`` (one column of that name);
    null ids stay.  Rows that the filter rules out stay where they are, only
    the others are joined, so most rows are never shuffled."""
    table, bits = id_filter(ids, id_col)
    data = df.sparkSession.sparkContext.broadcast(table)
    schema = StructType(df.schema.fields + [StructField("__maybe", BooleanType())])

    def mark(batches):
        bloom = data.value
        for batch in batches:
            spots = [batch.column(len(batch.columns) - 2 + i).to_numpy() for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + [pa.array(passes(bloom, *spots))],
                                             names=schema.names)

    marked = df.withColumns({f"__b{i}": spot(F.col(f"`{id_col}`"), i, bits) for i in (0, 1)}).mapInArrow(mark, schema)
    here = marked.filter("not __maybe").drop("__maybe")
    return here.unionByName(marked.filter("__maybe").drop("__maybe").join(ids, id_col, "left_anti")
                            .select(*[f"`{c}`" for c in df.columns]))
