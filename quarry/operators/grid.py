"""Two tables that meet in full, as a grid of tasks.

The left side is cut into ``rows`` groups and the right side into ``columns``;
every cell of the grid is a task's work: it holds one left group (which the
caller keeps bounded by the number of rows) and streams one right group past
it.  The left side is copied ``columns`` times and the right side ``rows``
times; no side passes the driver, none is broadcast, and no pair of rows is
ever a row.  Every cell is a partition of its own (a hash of the cells would
put several into one task and none into others).  A lost task is one cell,
done again from the shuffle.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(spark, rows: int, right_rows: int) -> tuple[int, int]:
    """Rows and columns of a grid with as many cells as the session's shuffle
    has partitions, if the right side has so many rows."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows, max(1, min(right_rows, -(-wanted // rows)))


def grid(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, rows: int,
         columns: int) -> DataFrame:
    """Both sides, dealt to the cells: ``__cell, __side`` (0 left, 1 right)
    and the columns of either side, rows of a cell adjacent, left ones first."""
    def dealt(side: int, table: DataFrame, key: Column, groups: int, copies: int) -> DataFrame:
        group = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        cell = F.col("__own") * columns + F.col("__copy") if side == 0 else F.col("__copy") * columns + F.col("__own")
        return (table.withColumn("__own", group).withColumn("__copy", copy)
                .withColumns({"__cell": cell.cast("int"), "__side": F.lit(side)}).drop("__own", "__copy"))

    both = dealt(0, left, left_key, rows, columns).unionByName(
        dealt(1, right, right_key, columns, rows), allowMissingColumns=True)
    return both.repartitionById(rows * columns, F.col("__cell")).sortWithinPartitions("__cell", "__side")


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        mark = batch.column("__cell").to_numpy().astype(np.int64) * 2 + batch.column("__side").to_numpy()
        cuts = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(mark))):
            yield int(mark[a]) // 2, int(mark[a]) % 2, batch.slice(a, b - a)


def cells(batches: Iterable[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """Run ``work(left, rights)`` for every cell: the left rows as one table
    and the right rows as a stream of batches; it yields batches."""
    for _, parts in groupby(_segments(batches), key=lambda s: s[0]):
        left: list[pa.RecordBatch] = []
        first = None
        for _, side, part in parts:
            if side:
                first = part
                break
            left.append(part)
        if left and first is not None:
            def rights(head=first, rest=parts):
                yield head
                for _, _, part in rest:
                    yield part

            yield from work(pa.Table.from_batches(left), rights())
