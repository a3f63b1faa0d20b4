"""Quality by the perplexity of a model of trusted text.

An interpolated modified Kneser-Ney byte model is trained on texts labelled
good; a text's perplexity is that of its bytes, with ``DAMP`` bytes of average
trusted text added so that a few odd bytes do not condemn a short text.  Each
language's limit is a high quantile of the perplexities of trusted texts that
did not train the model, so that share of trusted-like texts is kept; texts
above the limit are rejected.

Rows with ``crc32(doc_id) % 5 = 0`` set the limits, the other trusted rows
train, all of them.  Null and empty texts have average perplexity and are kept.  A null
language is a language of its own; one without trusted texts takes the limit
of all trusted texts.  Without trusted rows everything is kept.  Null labels
are skipped; an id with several labels is trusted if all are good.  An empty
table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.byte_models import count_windows, estimate, score
from quarry.llm.ids import maybe_ids
from quarry.llm.toxicity import fold
from quarry.session import materialize

DAMP = 100.0


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``__text, __lang, __fold`` of all trusted texts, written once.  A bounded
    filter of their ids keeps the texts of other rows where they are; what
    passes it meets the ids by an exact join."""
    good = (labels.filter("quality is not null and doc_id is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("q")).filter("q = 1"))
    good = materialize(good.select(F.col("doc_id").alias("__id")))
    named = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"),
                        F.col(f"`{lang_col}`").alias("__lang"))
    return materialize(
        maybe_ids(named, good, "__id").join(good, "__id").select("__text", "__lang", fold("__id").alias("__fold"), F.lit(0).alias("__class")))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", quantile: float = 0.99) -> DataFrame:
    """``doc_id, lang, perplexity, limit, keep`` for every document."""
    rows = trusted(docs, labels, id_col, text_col, lang_col)
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"),
                        F.col(f"`{text_col}`").alias("__text"))
    windows = count_windows(rows.filter("__fold > 0"), "__text", "__class", 1)
    grams = estimate(windows, 1)
    if grams.isEmpty():
        return named.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"),
                            F.lit(None).cast("double").alias("limit"), F.lit(True).alias("keep"))
    seen = materialize(score(rows.filter("__fold = 0"), grams, "__text", ["__lang"], 1))
    sums = seen.agg(F.sum("__total0").alias("t"), F.sum("__bytes").alias("b")).first()
    average = sums["t"] / sums["b"] if sums["b"] else 0.0

    def perplexity(frame: DataFrame) -> DataFrame:
        return frame.withColumn("perplexity", F.exp(
            -(F.col("__total0") + F.lit(DAMP * average)) / (F.col("__bytes") + F.lit(DAMP))))

    held = perplexity(seen)
    limits = held.groupBy("__lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit"))
    overall = held.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    scored = perplexity(score(named, grams, "__text", ["doc_id", "lang"], 1))
    # One row per language: looked up by a join that AQE may broadcast or split.
    return (scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
            .withColumn("limit", F.coalesce("limit", F.lit(overall).cast("double")))
            .select("doc_id", "lang", "perplexity", "limit",
                    F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True)).alias("keep")))
