"""Tabular sources and sinks.

CSV files are read with an explicit all-string schema (no inference, so
``N/A`` stays text), nested JSON question sets are exploded, parquet and
catalog tables are plain scans whose projections Catalyst prunes into the
scan.  Sinks overwrite; the format of managed tables is a parameter
(``delta`` where that package is on the class path, ``parquet`` here).
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the two reference CSV inputs.
CLAUSE_MAP_COLUMNS = ["ipc_section", "ipc_title", "bns_section", "bns_title", "summary_of_change"]
CATALOGUE_COLUMNS = ["scheme_id", "name", "ministry", "description", "eligibility", "url"]


def string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_csv_strings(spark: SparkSession, path: str, columns=None,
                     ordinal: str | None = None) -> DataFrame:
    """CSV with a header, every column a string.  With ``columns`` the schema
    is explicit; ``ordinal`` adds a sortable position in file order, which a
    DataFrame otherwise does not keep: file path, start of the block in the
    file, and a number that rises inside a block (one task reads it)."""
    reader = spark.read.option("header", True).option("multiLine", False)
    if columns is not None:
        reader = reader.schema(string_schema(columns))
    else:
        reader = reader.option("inferSchema", False)
    df = reader.csv(path)
    if ordinal:
        df = df.withColumn(ordinal, F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")))
    return df


def read_question_set(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON ``{version, description, items: [...]}`` -> one row per item
    with its position (``item_ord``)."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.posexplode("items").alias("item_ord", "item")).select("item_ord", "item.*")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds finished Parquet files, in any store that
    Spark reads (a job that failed may leave an empty folder)."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.parquet")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{loc}")


def write_table(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> None:
    """Overwrite a managed (or, with ``path``, external) table."""
    w = df.write.mode("overwrite").format(fmt)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Overwrite a table bucketed and sorted by ``key``: joins on that key
    read its rows where they are, so only the other side is shuffled.  One
    file per bucket, as rows are dealt by the bucket's hash before they are
    written."""
    w = (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, key).sortBy(key))
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(vectors: DataFrame, vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Vector-set manifest as one row: ``dim, min_dim, ntotal, metadata_columns``
    (a JSON array of the other column names).  One aggregate pass.  Sparse
    sets (``buckets``/``weights``) pass their bucket count as ``dim``; a set
    that does not fit it (a bucket outside, unequal lists) has ``min_dim`` -1."""
    meta = [c for c in vectors.columns if c not in (vector_col, "weights")]
    if dim is not None:
        fits = (F.coalesce(F.array_max(vector_col) < dim, F.lit(True))
                & F.coalesce(F.array_min(vector_col) >= 0, F.lit(True))
                & (F.size(vector_col) == F.size("weights")))
        aggs = [F.lit(dim).cast("long").alias("dim"),
                F.when(F.coalesce(F.every(fits), F.lit(True)), F.lit(dim)).otherwise(F.lit(-1))
                .cast("long").alias("min_dim")]
    else:
        aggs = [F.max(F.size(vector_col)).cast("long").alias("dim"),
                F.min(F.size(vector_col)).cast("long").alias("min_dim")]
    return vectors.agg(*aggs, F.count(F.lit(1)).cast("long").alias("ntotal")).withColumn(
        "metadata_columns", F.lit(json.dumps(meta)))


def write_manifest(vectors: DataFrame, path: str, vector_col: str = "embedding",
                   dim: int | None = None) -> DataFrame:
    m = manifest(vectors, vector_col, dim)
    first = m.first()
    if first["min_dim"] != first["dim"]:
        raise ValueError("vectors of different dimensions in one set")
    m.coalesce(1).write.mode("overwrite").json(path)
    return m
