"""A corpus pipeline of five stages over ``documents``: toxicity filter,
near-duplicate removal, benchmark decontamination, mixing to source weights,
sharding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of its
predecessor; ``run`` writes every stage's result as Parquet into the shared
checkpoint folder and reads it back for the next one.  All stages but the
last return the columns of ``documents``; the last adds the shard.  Empty
inputs give empty results; rows with null texts are neither toxic nor
duplicates nor leaks and are kept.  Stages that drop or repeat rows give each
row a number of its own first, so null and repeated ids are no matter.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontaminate import leaks
from quarry.llm.ids import without_ids
from quarry.llm.jaccard import jaccard_components
from quarry.llm.mixing import mix
from quarry.llm.queries import table
from quarry.llm.sharding import plain_layout, shard
from quarry.llm.toxicity import toxicity, train
from quarry.session import ensure_checkpoint_dir, materialize, scratch_tables, ship_package

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the models are trained on the labelled
    documents among ``docs``."""
    with scratch_tables(spark) as tables:
        model = train(docs, table(spark, sf_dir, "labels"))
        if model.grams is not None:
            tables.keep(model.grams)
    return toxicity(docs, model, docs.columns).filter("__score < 0.5").drop("__score")


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, written once with a number of their own."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), {"compression": "zstd"})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.75 or more
    over five-word shingles: that of the smallest id (null last)."""
    with scratch_tables(spark) as tables:
        rows = numbered(docs)
        groups = materialize(jaccard_components(rows, "__row").withColumnRenamed("doc_id", "__row"))
        order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
        first = (rows.select("__row", order.alias("place")).join(groups, "__row")
                 .groupBy("component_id").agg(F.min("place").alias("first")))
        gone = materialize(groups.join(first, "component_id").filter(F.col("__row") != F.col("first")["__row"])
                           .select("__row"))
        tables.keep(rows, gone)
    return without_ids(rows, gone, "__row").drop("__row")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    with scratch_tables(spark) as tables:
        rows = numbered(docs)
        found = leaks(rows, table(spark, sf_dir, "benchmark"), id_col="__row")
        gone = materialize(found.select(F.col("doc_id").alias("__row")).distinct())
        tables.keep(rows, gone)
    return without_ids(rows, gone, "__row").drop("__row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: complete epochs of its
    source are repeated rows."""
    rows = numbered(docs)
    taken = mix(rows, table(spark, sf_dir, "labels"), row_col="__row").filter("copies > 0").select(
        F.col("row").alias("__row"), F.col("copies").cast("int").alias("__copies"))
    return (rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(docs.columns))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard by the weighted hash tree; copies of a
    document go to the same shard."""
    return shard(docs, ["doc_id"], plain_layout(SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

# Learned scores, sampling keys and hash draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch_tables(spark) as tables:
            docs = materialize(stage(spark, docs, sf_dir))
            tables.keep(docs)
    return docs
