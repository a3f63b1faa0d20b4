"""Sharding by a hierarchical weighted hash tree.

The tree has three levels (region, rack, shard).  A key descends it: at each
node every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and
the child's name, and the smallest draw wins, so a child receives its share by
weight.  A draw depends on nothing but key, child and the child's weight:
raising a weight only pulls keys into that subtree, and only keys inside
subtrees whose weights change ever move.

``plain_layout`` numbers shards so that a ninth shard opens a region of its
own: it then takes keys only into itself.

Null keys: hashed as the absence of a value, so they share one shard.  Equal
keys share a shard.  An empty table gives an empty table.  Columns of the
input that bear the name of an output column are replaced.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

Layout = list[tuple[str, str, int, float]]  # region, rack, shard, weight


def plain_layout(n: int, per_rack: int = 2, racks: int = 2, weight: float = 1.0) -> Layout:
    """``n`` equal shards in racks of ``per_rack`` and regions of ``racks`` racks."""
    if n <= 0:
        raise ValueError("a layout needs at least one shard")
    return [(f"g{s // (per_rack * racks)}", f"r{s // per_rack}", s, weight) for s in range(n)]


def _children(layout: Layout) -> dict[str, list[tuple[str, float]]]:
    """Child names and summed weights of every inner node."""
    tree: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in layout:
        if not weight > 0:
            raise ValueError("weights must be positive")
        for node, child in (("", region), (region, f"{region}/{rack}"),
                            (f"{region}/{rack}", f"{region}/{rack}/{shard}")):
            tree.setdefault(node, {}).setdefault(child, 0.0)
            tree[node][child] += weight
    return {node: sorted(kids.items()) for node, kids in tree.items()}


def uniform(*cols) -> Column:
    """A hashed number in (0, 1) of the given columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(2**53))


def shard_of(key: list[Column], layout: Layout) -> Column:
    """The shard number of a key under ``layout``."""
    tree = _children(layout)
    kids = F.create_map(*[x for node, ch in sorted(tree.items()) for x in (
        F.lit(node), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight"))
                               for c, w in ch]))])
    node = F.lit("")
    for _ in range(3):
        node = F.array_min(F.transform(
            F.element_at(kids, node),
            lambda c: F.struct((-F.log(uniform(c["name"], *key)) / c["weight"]).alias("draw"),
                               c["name"].alias("name"))))["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def shard(df: DataFrame, key_cols: list[str], layout: Layout, column: str = "shard") -> DataFrame:
    """All columns of ``df`` plus the shard number; narrow, no shuffle."""
    return df.withColumn(column, shard_of([F.col(f"`{c}`") for c in key_cols], layout))


def slots(df: DataFrame, order: list[str], shard_col: str = "shard", column: str = "slot",
          block_rows: int = 20_000) -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without gaps.

    Rows of a shard are dealt to hash blocks (their number follows the row
    count, so a block stays bounded); blocks are numbered inside, and each
    block starts where the blocks before it end.  ``df`` should be narrow: it
    is written once.  Rows equal in all of ``order`` are interchangeable."""
    rows = materialize(df)
    n = rows.count()
    blocks = max(1, math.ceil(n / block_rows))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    starts = (rows.groupBy(shard_col, "__block").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__start", F.sum("__n").over(
                  Window.partitionBy(shard_col).orderBy("__block")) - F.col("__n"))
              .drop("__n"))
    inside = Window.partitionBy(shard_col, "__block").orderBy(*order)
    return (rows.join(starts, [shard_col, "__block"])
            .withColumn(column, F.col("__start") + F.row_number().over(inside) - 1)
            .drop("__block", "__start"))


def shard_digest(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard`` (the shard under one more shard); a null text has 1 byte of
    size and the checksum of no bytes."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = [F.col(f"`{id_col}`")]
    narrow = docs.select(
        key[0].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, plain_layout(n_shards)).alias("shard"),
        shard_of(key, plain_layout(n_shards + 1)).alias("grown_shard"))
    return (slots(narrow, ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", "law", "shard",
                    F.col("slot").cast("long").alias("slot"), "grown_shard"))
