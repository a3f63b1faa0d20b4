"""Streams (batch = stream, idempotent replay) and properties of the text
expressions on texts whose result is known from their parts."""
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions.text import parse_verdict, strip_reasoning
from quarry.operators.chunks import char_chunks
from quarry.session import scratch_path
from quarry.streaming.streams import chunk_stream, file_stream, write_batch


def test_chunk_stream_equals_batch(spark):
    base = scratch_path(spark, "t-stream")
    docs = spark.createDataFrame([(i, "word " * (i * 40)) for i in range(6)], "doc_id long, text string")
    docs.write.parquet(f"{base}/in")
    q = chunk_stream(file_stream(spark, f"{base}/in", docs.schema), f"{base}/sink", f"{base}/ck", 8, 2)
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{base}/sink").select("chunk_id", "text").collect()}
    want = char_chunks(docs.select("doc_id", F.col("doc_id").cast("string").alias("section_id"), "text"), 8, 2)
    assert got == {tuple(r) for r in want.select("chunk_id", "text").collect()}


def test_replayed_batch_replaces(spark):
    base = scratch_path(spark, "t-replay")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    write_batch(df, f"{base}/sink", 0)
    write_batch(df, f"{base}/sink", 0)  # the same batch again after a failure
    write_batch(df.limit(1), f"{base}/sink", 1)
    assert spark.read.parquet(f"{base}/sink").count() == 3


_word = st.text("abcdef ", max_size=20).map(str.strip)


@settings(max_examples=30, deadline=None)
@given(_word, _word, st.sampled_from(["</think>", "</THINK>", "</Think>"]))
def test_text_after_closed_reasoning_stays(spark, thought, reply, close):
    text = f"<think>{thought}{close}\n {reply} "
    assert spark.createDataFrame([(text,)], "t string").select(strip_reasoning("t").alias("c")).first().c == reply


@settings(max_examples=30, deadline=None)
@given(_word)
def test_text_without_reasoning_is_only_stripped(spark, reply):
    assert spark.createDataFrame([(f" \n{reply}\t",)], "t string").select(strip_reasoning("t").alias("c")).first().c == reply


_score = st.integers(-9, 9)


@settings(max_examples=30, deadline=None)
@given(_score, _score, st.text("ab ", max_size=5), st.sampled_from(["%s", " %s\n", "```json\n%s\n```", "```json%s```\n"]))
def test_verdicts_come_back_through_fences(spark, correctness, citation, reason, shape):
    raw = shape % json.dumps({"correctness": correctness, "citation": citation, "reason": reason})
    j = spark.createDataFrame([(raw,)], "v string").select(parse_verdict("v").alias("j")).first().j
    assert (j.correctness, j.citation, j.reason) == (correctness, citation, reason)
    broken = spark.createDataFrame([(raw.replace("}", ""),)], "v string").select(parse_verdict("v").alias("j")).first().j
    assert (broken.correctness, broken.citation, broken.reason) == (0, 0, "judge parse failure")
