"""Prompts, generation and answer records.

``generate`` runs a caller's model over a prompt column in Arrow batches
(``mapInArrow``: the model is built once per Python worker) and cleans its
output with the native ``strip_reasoning`` expression.  ``answer`` puts
retrieval, prompt, generation and catalogue matches into one record per
question; hits are aggregated per question (at most k rows each), so no
group grows with the data.
"""
from __future__ import annotations

import time
from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import CONTEXT_SEPARATOR, context_block, strip_reasoning, user_prompt
from quarry.operators.workers import factory_key, kept
from quarry.session import materialize
from quarry.sources.tables import written
from quarry.operators.retrieve import CATALOGUE_K, CATALOGUE_MIN, MIN_SCORE, TOP_K, match_catalogue, retrieve

def generate(df: DataFrame, model_factory: Callable[[], Callable[[str, str], str]],
             prompt_col: str = "prompt", system_prompt: str = "", out_col: str = "answer",
             clean: bool = True) -> DataFrame:
    """Add ``out_col`` (model output, cleaned), ``error`` and ``latency_ms``.

    ``model_factory()`` returns ``chat(system, user) -> str``; it is called
    once per Python worker.  A null prompt goes in as ''.  A call that fails
    gives a null output and its message in ``error`` (null otherwise), so a
    broken model shows and the other rows stay.  The other columns pass
    through as Arrow arrays, unchanged."""
    out_cols = [out_col, "error", "latency_ms"]
    src = df.drop(*out_cols)
    at = src.columns.index(prompt_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    schema += f", `{out_col}` string, error string, latency_ms int"
    key = factory_key(model_factory)

    def run(batches):
        chat = kept(key, model_factory)
        for batch in batches:
            outs, errors, took = [], [], []
            for prompt in batch.column(at).to_pylist():
                t0 = time.perf_counter()
                out = error = None
                try:
                    out = chat(system_prompt, "" if prompt is None else prompt)
                except Exception as e:  # kept with its row, not hidden
                    error = f"{type(e).__name__}: {e}"
                outs.append(None if out is None else str(out))
                errors.append(error)
                took.append(int((time.perf_counter() - t0) * 1000))
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(outs, pa.string()), pa.array(errors, pa.string()),
                                 pa.array(took, pa.int32())], names=batch.schema.names + out_cols)

    out = src.mapInArrow(run, schema)
    if clean:
        out = out.withColumn(out_col, strip_reasoning(out_col))
    return out


LEDGER = "digest string, output string, error string, latency_ms int, at timestamp"


def generate_once(df: DataFrame, model_factory: Callable[[], Callable[[str, str], str]], ledger: str,
                  prompt_col: str = "prompt", system_prompt: str = "", out_col: str = "answer",
                  model: str | None = None, group_rows: int = 10_000, clean: bool = True) -> DataFrame:
    """:func:`generate` through a ledger in shared storage: no finished call is
    made twice, by repeated prompts, by a rerun or after a failure.

    Calls are known by a digest of the ``model``'s name (default: a digest of
    its factory), the system prompt and the prompt.  Prompts that the table
    folder ``ledger`` does not hold are called in groups of about
    ``group_rows``; each group is written before the next one begins, so a run
    that breaks off loses one group at most.  Failed calls are noted with
    their error and made again by the next run."""
    spark = df.sparkSession
    model = model or factory_key(model_factory)
    key = F.sha2(F.concat_ws("\n", F.lit(model), F.sha2(F.lit(system_prompt), 256),
                             F.coalesce(F.col(prompt_col).cast("string"), F.lit(""))), 256)
    named = df.drop(out_col, "error", "latency_ms").withColumn("_digest", key)
    calls = named.select(F.col("_digest").alias("digest"), F.col(prompt_col).cast("string").alias("prompt"))
    calls = calls.dropDuplicates(["digest"])
    if written(spark, ledger):
        done = spark.read.schema(LEDGER).parquet(ledger).filter("error is null").select("digest").distinct()
        calls = calls.join(done, "digest", "left_anti")
    calls = materialize(calls)
    groups = -(-calls.count() // group_rows)
    for group in range(groups):
        mine = calls.filter(F.pmod(F.xxhash64("digest"), F.lit(groups)) == group)
        out = generate(mine, model_factory, "prompt", system_prompt, out_col="output", clean=False)
        out.select("digest", "output", "error", "latency_ms", F.current_timestamp().alias("at")
                   ).write.mode("append").parquet(ledger)
    rows = spark.read.schema(LEDGER).parquet(ledger) if written(spark, ledger) else spark.createDataFrame([], LEDGER)
    best = rows.groupBy(F.col("digest").alias("_digest")).agg(F.max_by(
        F.struct("output", "error", "latency_ms"), F.struct(F.col("error").isNull(), "at")).alias("_r"))
    out = named.join(best, "_digest", "left")
    text = strip_reasoning("_r.output") if clean else F.col("_r.output")
    return out.withColumns({out_col: text, "error": F.col("_r.error"), "latency_ms": F.col("_r.latency_ms")}
                           ).drop("_digest", "_r")


def citations(hits: DataFrame, question_id: str = "query_id") -> DataFrame:
    """Per question: ``citations array<struct<rank, passage_id, chunk_id,
    section_id, title, text, score>>`` in rank order, and the joined context."""
    chunk = "chunk_id" if "chunk_id" in hits.columns else "hit_id"
    agg = hits.groupBy(F.col(question_id)).agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("hit_id").cast("string").alias("passage_id"),
        F.col(chunk).cast("string").alias("chunk_id"), "section_id", "title", "text", "score"))).alias("citations"))
    ctx = F.array_join(F.transform("citations", lambda c: context_block(c["section_id"], c["title"],
                                                                        c["text"])), CONTEXT_SEPARATOR)
    return agg.withColumn("context", ctx)


def prompts(questions: DataFrame, hits: DataFrame, question_id: str = "query_id",
            question_text: str = "question") -> DataFrame:
    """Questions with their citations and user prompt (no hits: the
    no-context prompt)."""
    c = citations(hits.withColumnRenamed("query_id", question_id), question_id)
    return (questions.join(c, question_id, "left")
            .withColumn("prompt", user_prompt(question_text, "context")))


# The same type with and without a catalogue, whatever its columns.
SCHEMES = "array<struct<rank:int,id:string,score:double,fields:map<string,string>>>"


def answer(questions: DataFrame, passages: DataFrame,
           model_factory: Callable[[], Callable[[str, str], str]], *,
           catalogue: DataFrame | None = None, catalogue_kw: dict | None = None,
           k: int = TOP_K, min_score: float = MIN_SCORE, question_id: str = "query_id",
           question_text: str = "question", passage_id: str = "passage_id",
           system_prompt: str = "", encoder_factory=None, **search_kw) -> DataFrame:
    """One record per question: ``question_id, question, answer, error,
    citations, schemes, latency_ms`` (schemes empty without a catalogue;
    ``latency_ms`` is the model call's).  ``encoder_factory`` encodes
    questions, passages and catalogue."""
    hits = retrieve(questions, passages, k, min_score, question_id=question_id,
                    question_text=question_text, passage_id=passage_id, encoder_factory=encoder_factory,
                    attach=["chunk_id", "section_id", "title", "text"], **search_kw)
    p = prompts(questions.select(question_id, question_text), hits, question_id, question_text)
    out = generate(p, model_factory, "prompt", system_prompt)
    empty_cites = F.array().cast(out.schema["citations"].dataType)
    out = out.withColumn("citations", F.coalesce("citations", empty_cites))
    no_schemes = F.array().cast(SCHEMES)
    if catalogue is not None:
        kw = dict(catalogue_kw or {})
        cid = kw.get("catalogue_id", "scheme_id")
        m = match_catalogue(questions, catalogue, kw.pop("k", CATALOGUE_K), kw.pop("min_score", CATALOGUE_MIN),
                            question_id=question_id, question_text=question_text,
                            encoder_factory=encoder_factory, **kw)
        fields = F.create_map(*[x for c in catalogue.columns if c != cid
                                for x in (F.lit(c), F.col(c).cast("string"))]) \
            if len(catalogue.columns) > 1 else F.create_map().cast("map<string,string>")
        # Sorted by rank before the map is put in: maps have no order.
        rows = m.select("query_id", F.struct(F.col("rank").cast("int").alias("rank"),
                                             F.col("hit_id").cast("string").alias("id"), "score",
                                             fields.alias("fields")).alias("s"))
        schemes = rows.groupBy("query_id").agg(F.array_sort(
            F.collect_list("s"), lambda a, b: a["rank"] - b["rank"]).cast(SCHEMES).alias("schemes"))
        out = out.join(schemes.withColumnRenamed("query_id", question_id), question_id, "left")
        out = out.withColumn("schemes", F.coalesce("schemes", no_schemes))
    else:
        out = out.withColumn("schemes", no_schemes)
    return out.select(question_id, question_text, "answer", "error", "citations", "schemes", "latency_ms")


def traces(answers: DataFrame, params: dict, question_id: str = "query_id",
           question_text: str = "question", batch: str = "") -> DataFrame:
    """Trace rows for answered questions: ``run_id, logged_at, params map,
    metrics map, trace`` (the nested record as JSON).  ``run_id`` follows from
    the batch's name, the question, its id and the parameters, so that the
    same run has the same ids."""
    pairs = [(k, str(v)) for k, v in sorted(params.items())]
    pmap = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    metrics = F.create_map(F.lit("latency_ms"), F.col("latency_ms").cast("double"),
                           F.lit("n_citations"), F.size("citations").cast("double"),
                           F.lit("n_schemes"), F.size("schemes").cast("double"))
    trace = F.to_json(F.struct(F.col(question_text).alias("question"), "answer", "citations", "schemes"))
    seed = F.concat_ws("\n", F.lit(repr((batch, pairs))), F.coalesce(F.col(question_text), F.lit("")))
    run = F.concat(F.substring(F.sha2(seed, 256), 1, 32), F.lit("-"), F.col(question_id).cast("string"))
    return answers.select(run.alias("run_id"), F.current_timestamp().alias("logged_at"),
                          pmap.alias("params"), metrics.alias("metrics"), trace.alias("trace"))


def append_traces(answers: DataFrame, path: str, params: dict, **kw) -> None:
    """Append trace rows to a table folder (parquet).  Runs that the folder
    has already are left out, so repeating a batch leaves one trace a
    question."""
    rows = traces(answers, params, **kw).dropDuplicates(["run_id"])
    spark = rows.sparkSession
    if written(spark, path):
        rows = rows.join(spark.read.parquet(path).select("run_id"), "run_id", "left_anti")
    rows.write.mode("append").parquet(path)
