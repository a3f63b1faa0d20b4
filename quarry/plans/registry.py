"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables; every computed column is aliased and cast the same way in the SQL.
Array columns are joined into strings or exploded, as the check compares
flat values.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir, ship_package
from quarry.sources.tables import read_parquet

DEALT = ("documents", "embeddings")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    df = read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
    # A check table may be one row group, which one task must read: where a
    # scan has fewer splits than the cluster cores, its rows are dealt to all.
    # Larger tables, and the library itself, are never shuffled for that.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in DEALT and df.rdd.getNumPartitions() < cores else df


def load_all() -> None:
    """Import every check module, which fills the registry."""
    from quarry.plans import answer_checks, corpus_checks, io_checks, search_checks  # noqa: F401
