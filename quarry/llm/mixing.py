"""Mixing sources to target weights by exponential keys.

Every source gets a target number of words; a document is taken whole, in
complete epochs first, and the rest of the target is filled by a weighted
sample without replacement: each document draws the key ``-ln(u) / weight``
(``u`` hashed from its id, ``weight`` from its quality), documents are sorted
by key within their source, and the prefix of the sorted words that fits the
rest of the target is taken.  A document is in the prefix if its middle word
is, so the words taken miss the target by half a document at most.

The prefix sums are two-level: keys are cut into bins by value, bins are
summed per source, and rows are sorted only inside their bin, so a source
that holds most of the table is spread over many groups.

Null text: 0 words.  Null source: a source of its own, last in order.  Null
or repeated ids: rows with equal id and size are interchangeable.  A source
without words has target 0 and its documents are taken 0 or more times
without adding words.  An empty table gives an empty table.  Only DataFrame
functions are used.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.sharding import uniform
from quarry.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """``docs`` with a column ``__weight``: ``good`` where quality is 1,
    ``bad`` where it is 0, else 1."""
    known = (labels.filter("quality is not null")
             .groupBy(F.col("doc_id").alias(id_col)).agg(F.max("quality").alias("__q")))
    return (docs.join(known, id_col, "left")
            .withColumn("__weight", F.when(F.col("__q") == 1, good).when(F.col("__q") == 0, bad)
                        .otherwise(1.0)).drop("__q"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0),
                   share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From ``source, source_size`` (one row per source) the words each source
    should give: ``share`` of all words by the repeating ``weights``, at most
    ``cap`` times its size, the excess reshared by weight.

    With sources sorted by ``cap * size / weight`` the capped ones come first;
    the level that the others share is the first one that the next source can
    hold.  The table has one row per source, so one window holds it."""
    everything = Window.orderBy("__ratio", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = (sizes
              .withColumn("__rank", F.row_number().over(
                  Window.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("__w", F.get(w, F.col("__rank") % len(weights)))
              .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
              .withColumn("__ratio", F.col("__cap") / F.col("__w")))
    levels = (ranked
              .withColumn("__left", F.sum("source_size").over(whole) * F.lit(float(share))
                          - F.coalesce(F.sum("__cap").over(everything), F.lit(0.0)))
              .withColumn("__open", F.sum("__w").over(whole)
                          - F.coalesce(F.sum("__w").over(everything), F.lit(0.0)))
              .withColumn("__level", F.col("__left") / F.col("__open"))
              .withColumn("__first", F.min(F.when(
                  F.col("__level") <= F.col("__ratio"),
                  F.struct("__ratio", "__rank", "__level"))).over(whole)))
    return levels.select(
        "source", "source_size",
        F.when(F.col("__first").isNull(), F.col("__cap"))
        .otherwise(F.least(F.col("__cap"), F.col("__first")["__level"] * F.col("__w"))).alias("target"))


def take(rows: DataFrame, targets: DataFrame, seed: int = 0, bin_rows: int = 2_000) -> DataFrame:
    """``rows`` (``doc_id, source, size, weight``) with ``source_size, target``
    and ``copies``, how often the mix takes the document."""
    draw = -F.log(uniform(F.lit(seed), F.col("doc_id"))) / F.col("weight")
    rows = materialize(rows.withColumn("__key", draw))
    bins = max(1, math.ceil(rows.count() / bin_rows))
    rows = rows.withColumn(
        "__bin", F.least(F.floor((1 - F.exp(-F.col("__key"))) * bins), F.lit(bins - 1)).cast("int"))
    starts = (rows.groupBy("source", "__bin").agg(F.sum("size").alias("__words"))
              .withColumn("__start", F.sum("__words").over(
                  Window.partitionBy("source").orderBy("__bin")) - F.col("__words"))
              .join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
              .select(F.col("source").alias("__s"), F.col("__bin").alias("__b"), "__start",
                      "source_size", "target"))
    inside = (Window.partitionBy("source", "__bin").orderBy("__key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))) \
        .otherwise(F.lit(0)).cast("long")
    return (rows.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
            .withColumn("__middle", F.col("__start") + F.sum("size").over(inside) - F.col("size") / 2)
            .withColumn("__epochs", epochs)
            .withColumn("copies", F.col("__epochs") + F.when(
                F.col("__middle") <= F.col("target") - F.col("__epochs") * F.col("source_size"),
                F.lit(1)).otherwise(F.lit(0)))
            .drop("__s", "__b", "__bin", "__start", "__middle", "__epochs", "__key"))


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = 0, row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    copies, taken``, and ``row``, the column ``row_col``, if that is given."""
    row = [F.col(f"`{row_col}`").alias("row")] if row_col else []
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                         word_count(F.col(f"`{text_col}`")).alias("size"), *row)
    rows = materialize(quality_weights(narrow, labels).withColumnRenamed("__weight", "weight"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    return (take(rows, targets, seed)
            .withColumn("taken", F.col("copies") * F.col("size")))
