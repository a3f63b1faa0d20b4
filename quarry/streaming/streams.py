"""Streams.

* ``chunk_stream``: documents arriving as files are sectioned and chunked
  by the same native expressions as in batch (they are stateless), and
  appended to a parquet sink; the checkpoint makes a restart exactly-once.
* ``answer_stream``: questions arriving as files are ranked against a
  static passage set in ``foreachBatch`` (row ranking over a stream is not
  allowed, but inside a micro-batch it is a batch job).  Each micro-batch
  overwrites only its own ``batch_id`` partition, so a replayed batch after
  a failure replaces, never duplicates, its rows.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import strip
from quarry.operators.answers import answer, traces
from quarry.operators.chunks import char_chunks
from quarry.operators.sections import split_sections


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in ``directory``.  ``glob`` names or matches the
    files in it that count, or folders whose files count."""
    r = spark.readStream.schema(schema)
    if glob:  # a pattern in any case: the path of a stream is a folder or a pattern
        plain = not any(c in glob for c in "*?[{")
        directory = f"{directory.rstrip('/')}/{'{' + glob + '}' if plain else glob}"
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def chunk_stream(docs: DataFrame, sink: str, checkpoint: str, chunk_tokens: int = 512,
                 overlap: int = 64, sections: bool = False, id_col: str = "doc_id",
                 text_col: str = "text", available_now: bool = True):
    """Start the chunking stream; returns the ``StreamingQuery``."""
    if sections:
        s = split_sections(docs, text_col, keys=(id_col,))
        out = char_chunks(s, chunk_tokens, overlap, keep=[id_col, "section_ord", "title", "section_id"])
    else:
        d = docs.select(id_col, F.col(id_col).cast("string").alias("section_id"), text_col)
        out = char_chunks(d, chunk_tokens, overlap, text_col=text_col, keep=[id_col, "section_id"])
    w = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def write_batch(result: DataFrame, sink: str, batch_id: int) -> None:
    """Write one micro-batch's result to ``sink/batch_id=N``, replacing what
    a previous attempt of the same batch wrote."""
    result.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")


def answer_stream(questions: DataFrame, rank_batch: Callable[[DataFrame], DataFrame], sink: str,
                  checkpoint: str, available_now: bool = True):
    """Run ``rank_batch`` on every micro-batch of questions and write its
    result under ``sink/batch_id=N`` (idempotent per batch)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(rank_batch(batch), sink, batch_id)

    w = questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def answer_and_trace(batch: DataFrame, passages: DataFrame, model_factory, params: dict, *,
                     question_id: str = "query_id", question_text: str = "question", **answer_kw) -> DataFrame:
    """Trace rows of a micro-batch of questions: retrieval, generation and
    catalogue matches, with parameters and metrics."""
    a = answer(batch, passages, model_factory, question_id=question_id, question_text=question_text, **answer_kw)
    return traces(a, params, question_id=question_id, question_text=question_text)


def answers_with_traces(questions: DataFrame, passages: DataFrame, model_factory, sink: str, checkpoint: str,
                        params: dict | None = None, available_now: bool = True, **answer_kw):
    """Answer every question of a stream and append its trace row to
    ``sink`` (one folder per micro-batch, replaced if the batch is replayed)."""
    return answer_stream(questions, lambda batch: answer_and_trace(
        batch, passages, model_factory, params or {}, **answer_kw), sink, checkpoint, available_now)


def first_questions(questions: DataFrame, time_col: str, text_col: str = "question", delay: str = "1 hour") -> DataFrame:
    """A stream of questions in which a text that repeats within ``delay`` of
    event time passes once.  The state holds one row for each distinct text
    until the watermark has passed it; rows later than the watermark go."""
    return (questions.filter(strip(F.coalesce(F.col(text_col), F.lit(""))) != "")
            .withWatermark(time_col, delay).dropDuplicatesWithinWatermark([text_col]))


def answer_repeats(spark: SparkSession, asked: DataFrame, hits_sink: str, question_id: str = "query_id",
                   text_col: str = "question") -> DataFrame:
    """All asked questions with the hits that the first one of their text got:
    ``hits_sink`` is the sink of an :func:`answer_stream` over
    :func:`first_questions` whose rows carry ``text_col``.  Of several batches
    that answered a text the first one counts."""
    hits = spark.read.parquet(hits_sink)
    first = hits.groupBy(text_col).agg(F.min("batch_id").alias("batch_id"))
    hits = hits.join(first, [text_col, "batch_id"]).drop("batch_id")
    return asked.select(question_id, text_col).join(hits.drop(question_id), text_col)
