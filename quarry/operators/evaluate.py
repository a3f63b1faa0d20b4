"""Evaluation of a question set: hit@k flags, judge verdicts, totals.

Per question the retrieved ids are a sorted ``collect_list`` of at most k
hits; the totals are one global aggregate (partial per task, one row to
merge).  Judging reuses ``generate`` with the judge prompt, then the
fence-stripping verdict parser.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import judge_prompt, parse_verdict
from quarry.operators.answers import answer, generate
from quarry.session import materialize


def hit_flags(items: DataFrame, hits: DataFrame, item_id: str = "query_id",
              expected: str | DataFrame = "expected_section", hit_section: str = "section_id",
              k: int = 5) -> DataFrame:
    """Items with ``retrieved array<string>`` (ids in rank order, not made
    distinct), ``in_top_k`` and ``in_top_1``.  ``expected`` names the column
    that holds the one right id, or an array of ids that all count as right;
    any number of right ids may also come as a table of rows ``(item_id,
    expected_id)``, of which only those that are among an item's hits are
    gathered: as ``expected_found`` (sorted), or else its smallest right id."""
    if isinstance(expected, DataFrame):
        return _flags_from_rows(items, hits, item_id, expected, hit_section, k)
    per = hits.groupBy(F.col("query_id").alias(item_id)).agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("r"),
                                             F.col(hit_section).cast("string").alias("s")))).alias("_h"))
    per = per.select(item_id, F.transform("_h", lambda x: x["s"]).alias("retrieved"))
    out = items.join(per, item_id, "left").withColumn(
        "retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    exp = F.col(expected)
    if isinstance(items.schema[expected].dataType, T.ArrayType):
        exp = exp.cast("array<string>")
    else:
        exp = F.array(exp.cast("string"))
    return (out.withColumn(f"in_top_{k}", F.coalesce(F.arrays_overlap(F.slice("retrieved", 1, k), exp),
                                                     F.lit(False)))
            .withColumn("in_top_1", F.coalesce(F.array_contains(exp, F.get("retrieved", 0)), F.lit(False))))


def _flags_from_rows(items: DataFrame, hits: DataFrame, item_id: str, expected: DataFrame, hit_section: str,
                     k: int) -> DataFrame:
    """Hits meet the rows of right ids by a join, so that an item with very
    many right ids never becomes one row."""
    right = expected.select(F.col(item_id).alias("_i"), F.col("expected_id").cast("string").alias("_e")).distinct()
    rows = hits.select(F.col("query_id").alias("_i"), F.col("rank").cast("int").alias("r"),
                       F.col(hit_section).cast("string").alias("_e"))
    marked = rows.join(right.withColumn("_ok", F.lit(True)), ["_i", "_e"], "left")
    per = marked.groupBy("_i").agg(
        F.sort_array(F.collect_list(F.struct("r", F.col("_e").alias("s")))).alias("_h"),
        F.array_sort(F.collect_set(F.when(F.col("_ok") & (F.col("r") <= k), F.col("_e")))).alias("_found"),
        F.max(F.coalesce(F.col("_ok"), F.lit(False)) & (F.col("r") <= k)).alias("_any"),
        F.max(F.coalesce(F.col("_ok"), F.lit(False)) & (F.col("r") == 1)).alias("_one"))
    least = right.groupBy("_i").agg(F.min("_e").alias("_least"))
    out = items.join(per.withColumnRenamed("_i", item_id), item_id, "left").join(
        least.withColumnRenamed("_i", item_id), item_id, "left")
    found = F.coalesce("_found", F.array().cast("array<string>"))
    return (out.withColumn("retrieved", F.coalesce(F.transform("_h", lambda x: x["s"]), F.array().cast("array<string>")))
            .withColumn("expected_found", F.when((F.size(found) == 0) & F.col("_least").isNotNull(), F.array("_least"))
                        .otherwise(found))
            .withColumn(f"in_top_{k}", F.coalesce("_any", F.lit(False)))
            .withColumn("in_top_1", F.coalesce("_one", F.lit(False)))
            .drop("_h", "_found", "_any", "_one", "_least"))


def judge(rows: DataFrame, model_factory: Callable[[], Callable[[str, str], str]],
          question: str = "question", expected: str = "expected_section", answer: str = "answer",
          system_prompt: str = "") -> DataFrame:
    """Add ``judge struct<correctness int, citation int, reason string>`` and
    ``judge_error`` (null unless the judge's call failed)."""
    p = rows.withColumn("_judge_prompt", judge_prompt(question, F.col(expected).cast("string"), answer))
    kept = {c: f"_{c}_kept" for c in ("error", "latency_ms") if c in rows.columns}
    g = generate(p.withColumnsRenamed(kept), model_factory, "_judge_prompt", system_prompt,
                 out_col="_verdict").withColumnRenamed("error", "judge_error").drop("latency_ms")
    g = g.withColumnsRenamed({v: k for k, v in kept.items()})
    return g.withColumn("judge", parse_verdict("_verdict")).drop("_judge_prompt", "_verdict")


def totals(rows: DataFrame, k: int = 5) -> DataFrame:
    """``hit_at_k, hit_at_1, judge_correctness_avg (sum/5n),
    judge_citation_avg, n_examples``; n = 0 gives NULL rates."""
    n = F.count(F.lit(1))
    cols = [F.avg(F.col(f"in_top_{k}").cast("int")).alias(f"hit_at_{k}"),
            F.avg(F.col("in_top_1").cast("int")).alias("hit_at_1")]
    if "judge" in rows.columns:
        cols += [F.try_divide(F.sum(F.col("judge.correctness")).cast("double"), n * 5)
                 .alias("judge_correctness_avg"),
                 F.try_divide(F.sum(F.col("judge.citation")).cast("double"), n)
                 .alias("judge_citation_avg")]
    cols.append(n.alias("n_examples"))
    return rows.agg(*cols)


def write_results(rows: DataFrame, metrics: DataFrame, path: str) -> None:
    """Per-item results and the totals as JSON folders."""
    rows.write.mode("overwrite").json(f"{path.rstrip('/')}/results")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/metrics")


def evaluate(items: DataFrame, passages: DataFrame, model_factory, judge_factory, path: str | None = None, *,
             k: int = 5, question_id: str = "query_id", question_text: str = "question",
             expected: str | DataFrame = "expected_section", system_prompt: str = "", judge_system: str = "",
             **answer_kw) -> tuple[DataFrame, DataFrame]:
    """A question set end to end: answers (without a catalogue), hit flags
    against the cited sections, verdicts and totals.  ``expected`` is as in
    :func:`hit_flags`.  With ``path`` both tables are written there as JSON.
    Returns ``(rows, totals)``."""
    a = answer(items, passages, model_factory, k=k, question_id=question_id, question_text=question_text,
               system_prompt=system_prompt, **answer_kw)
    a = materialize(items.join(a.drop(question_text), question_id))  # the model runs once
    hits = a.select(F.col(question_id).alias("query_id"), F.inline("citations")).select("query_id", "rank", "section_id")
    rows = hit_flags(a.drop("citations", "schemes"), hits, question_id, expected, "section_id", k)
    several = "expected_found" if isinstance(expected, DataFrame) else expected
    if isinstance(rows.schema[several].dataType, T.ArrayType):
        shown = rows.withColumn("_shown", F.array_join(F.col(several).cast("array<string>"), " or "))
        rows = judge(shown, judge_factory, question_text, "_shown", "answer", judge_system).drop("_shown")
    else:
        rows = judge(rows, judge_factory, question_text, expected, "answer", judge_system)
    rows = materialize(rows)
    metrics = totals(rows, k)
    if path is not None:
        write_results(rows, metrics, path)
    return rows, metrics
