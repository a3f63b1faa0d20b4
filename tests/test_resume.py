"""Vector sets, generation and traces that survive restarts and repeats."""
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators.answers import LEDGER, append_traces, generate_once
from quarry.plans.ingest import load_vectors, update_vectors


def noting_encoder(path):
    def factory():
        def encode(texts):
            with open(path, "a") as f:
                f.writelines("x\n" for _ in texts)
            return [[float(len(t)), 1.0] for t in texts]
        return encode
    return factory


def lines(path):
    return sum(1 for _ in open(path)) if os.path.exists(path) else 0


def test_only_unseen_texts_are_encoded(spark, tmp_path):
    note, base = str(tmp_path / "calls"), str(tmp_path / "set")
    rows = [(i, f"text {i % 80}") for i in range(100)] + [(100, None)]
    df = spark.createDataFrame(rows, "passage_id long, text string")
    update_vectors(df, base, encoder_factory=noting_encoder(note), encoder="e1")
    assert lines(note) == 81
    more = df.unionByName(spark.createDataFrame([(200, "new"), (201, "text 3")], df.schema)).filter("passage_id > 5")
    m = update_vectors(more, base, encoder_factory=noting_encoder(note), encoder="e1")
    assert lines(note) == 82 and m.first()["ntotal"] == more.count()
    vectors = load_vectors(spark, base)[0]
    assert {r.passage_id for r in vectors.collect()} == {r.passage_id for r in more.collect()}
    by_id = {r.passage_id: r.embedding for r in vectors.collect()}
    assert by_id[201] == by_id[83]
    update_vectors(more, base, encoder_factory=noting_encoder(note), encoder="e2")  # another encoder
    assert lines(note) == 82 + 82
    with pytest.raises(ValueError):
        update_vectors(df.limit(0), base)


def breaking_model(note, broken):
    def factory():
        def chat(system, user):
            if os.path.exists(broken) and user == "p7":
                raise SystemExit("killed")  # not an Exception: the task dies
            if user == "p3" and os.path.exists(broken):
                raise ValueError("busy")
            with open(note, "a") as f:
                f.write(user + "\n")
            return user.upper()
        return chat
    return factory


def test_a_killed_run_repeats_no_finished_call(spark, tmp_path):
    note, broken, ledger = str(tmp_path / "calls"), str(tmp_path / "broken"), str(tmp_path / "ledger")
    model = breaking_model(note, broken)
    df = spark.createDataFrame([(i, f"p{i % 20}") for i in range(40)], "id long, prompt string").coalesce(1)
    open(broken, "w").close()
    with pytest.raises(Exception):
        generate_once(df, model, ledger, group_rows=2, model="m").collect()
    finished = {r.digest for r in spark.read.schema(LEDGER).parquet(ledger).filter("error is null").collect()}
    os.remove(broken)
    before = lines(note)
    out = {r.id: (r.answer, r.error) for r in generate_once(df, model, ledger, group_rows=2, model="m").collect()}
    assert out == {i: (f"P{i % 20}", None) for i in range(40)}
    assert lines(note) - before == 20 - len(finished)
    generate_once(df, model, ledger, group_rows=2, model="m").collect()
    assert lines(note) - before == 20 - len(finished)  # nothing is called again


def test_failed_calls_show_and_are_made_again(spark, tmp_path):
    note, broken, ledger = str(tmp_path / "calls"), str(tmp_path / "broken"), str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "p3"), (2, "p4"), (3, None)], "id long, prompt string")
    open(broken, "w").close()
    first = {r.id: (r.answer, r.error) for r in generate_once(df, breaking_model(note, broken), ledger, model="m").collect()}
    assert first[1] == (None, "ValueError: busy") and first[2] == ("P4", None) and first[3] == ("", None)
    os.remove(broken)
    again = {r.id: (r.answer, r.error) for r in generate_once(df, breaking_model(note, broken), ledger, model="m").collect()}
    assert again[1] == ("P3", None) and lines(note) == 3


def test_the_same_batch_leaves_one_trace(spark, tmp_path):
    path = str(tmp_path / "traces")
    a = spark.createDataFrame([(1, "q", "a"), (2, "q", "b")], "query_id long, question string, answer string").withColumns(
        {"citations": F.array().cast("array<string>"), "schemes": F.array().cast("array<string>"), "latency_ms": F.lit(3)})
    for _ in range(2):
        append_traces(a, path, {"k": 5}, batch="monday")
    assert spark.read.parquet(path).count() == 2
    append_traces(a, path, {"k": 5}, batch="tuesday")
    append_traces(a, path, {"k": 6}, batch="monday")
    assert spark.read.parquet(path).count() == 6
