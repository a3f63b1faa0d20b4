"""Connected components of an edge table by alternating large and small stars.

The distinct edges are dealt to tasks of a bounded number of edges, and each
task replaces its edges by the stars of its own forest.  Then rounds move
edges towards the smallest id around: neighbours above a node are tied to the
smallest neighbour, then neighbours below it, until the edge table is one star
per component.  Rounds grow with the logarithm of the component's diameter;
nothing is collected but counts and a checksum.  Edges that fit one task need
no rounds."""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _smallest(edges: DataFrame) -> DataFrame:
    """Written first: the join with the edges is then one of two plain
    exchanges, and a node with very many edges can be split."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")))


def forest(edges: DataFrame) -> DataFrame:
    """``u, v`` of each task's edges as stars: every node with the smallest
    node of its tree."""
    types = edges.schema

    def run(batches):
        up: dict = {}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        names, kind = None, None
        for batch in batches:
            names, kind = batch.schema.names, batch.schema.types
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(x, x)
                up.setdefault(y, y)
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            rows = [(x, find(x)) for x in up]
            rows = [r for r in rows if r[0] != r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind[i]) for i in (0, 1)], names=names)

    return edges.mapInArrow(run, types)


def components(edges: DataFrame, a: str, b: str, task_edges: int = 250_000) -> DataFrame:
    """``id, component`` for every id that an edge joins to a smaller one:
    ``component`` is the smallest id reachable.  Other ids are their own
    component and not listed.  Null ends are skipped."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a, b)
         .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
         .select("u", "v").distinct())
    e = materialize(e)
    tasks = max(1, math.ceil(e.count() / task_edges))
    e = materialize(forest(e.coalesce(tasks)))
    if tasks == 1:  # one bounded task held every edge: its stars are the components
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest(both).withColumn("m", F.least("m", "u"))
        # large star: for every neighbour v above u
        e = materialize(e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: for every neighbour v below u, and u itself
        least = _smallest(e)
        low = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(low.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
