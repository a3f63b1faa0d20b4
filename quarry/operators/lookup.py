"""Lookups through normalised keys.

A mapping table is reduced to its first row per normalised key (table order
given by an ordinal column) with ``min_by`` in a ``groupBy``: that is a
partial aggregate, so even a key holding a third of all rows is reduced to
one row per map task before the shuffle.  The join to the looked-up keys is a
plain equi-join: Spark broadcasts the mapping only when its estimated size is
under ``spark.sql.autoBroadcastJoinThreshold`` (or AQE measures it so at run
time); otherwise it shuffles both sides on the key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalise_key

KEY = "_key"


def first_per_key(mapping: DataFrame, key: Column, order_col: str) -> DataFrame:
    """First row (lowest ``order_col``) per normalised key: ``_key`` + columns."""
    cols = mapping.columns
    return (mapping.withColumn(KEY, normalise_key(key))
            .groupBy(KEY).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_row"))
            .select(KEY, "_row.*"))


def lookup(keys: DataFrame, key_col: str, mapping: DataFrame) -> DataFrame:
    """Rows of ``keys`` with their mapping row; keys without one drop out."""
    return keys.withColumn(KEY, normalise_key(key_col)).join(mapping, KEY, "inner").drop(KEY)


def unmatched(keys: DataFrame, key_col: str, mapping: DataFrame) -> DataFrame:
    """Distinct looked-up keys that have no mapping row."""
    return (keys.select(key_col).distinct()
            .withColumn(KEY, normalise_key(key_col))
            .join(mapping.select(KEY), KEY, "left_anti").drop(KEY))


def list_all(df: DataFrame, columns, order_col: str, limit: int | None = None) -> DataFrame:
    """All rows projected and ordered (``limit`` keeps the first n, as a report)."""
    out = df.select(*columns).orderBy(order_col)
    return out.limit(limit) if limit else out
