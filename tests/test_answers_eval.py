"""Generation, answers, traces and evaluation totals."""
import json

from pyspark.sql import functions as F

from quarry.operators.answers import answer, generate, traces
from quarry.operators.evaluate import hit_flags, judge, totals
from quarry.plans import callables
from quarry.sources.tables import read_question_set


def test_generate_cleans_and_shows_failures(spark):
    def factory():
        def chat(system, user):
            if user == "boom":
                raise RuntimeError("model failed")
            return "<think>x</think>  " + user.upper()
        return chat
    df = spark.createDataFrame([(9007199254740993, "abc"), (2, "boom"), (None, None)], "id long, prompt string")
    got = {r.id: (r.answer, r.error) for r in generate(df, factory).collect()}
    assert got == {9007199254740993: ("ABC", None), 2: (None, "RuntimeError: model failed"), None: ("", None)}


def test_models_are_built_once_per_worker_and_not_mixed_up(spark, tmp_path):
    import os

    from quarry.operators.embed import embed

    def make(name):
        def factory():
            with open(f"{tmp_path}/{name}-{os.getpid()}", "a") as f:
                f.write("x")
            return lambda system, user: name
        return factory

    def encoder():
        with open(f"{tmp_path}/encoder-{os.getpid()}", "a") as f:
            f.write("x")
        return lambda texts: [[1.0] for _ in texts]

    df = spark.range(64).selectExpr("id", "'p' as prompt").repartition(16)
    for _ in range(2):
        first = generate(df, make("one")).withColumnsRenamed({"answer": "a1", "error": "e1", "latency_ms": "l1"})
        assert {(r.a1, r.answer) for r in generate(first, make("two")).collect()} == {("one", "two")}
        assert embed(df, encoder, "prompt", keep=["id"]).count() == 64
    builds = [(tmp_path / f).read_text() for f in os.listdir(tmp_path)]
    assert builds and set(builds) == {"x"}


def test_answer_bundle_and_trace(spark):
    passages = spark.createDataFrame(
        [("BNS_303::chunk_0000", "BNS_303", "Theft", "Any theft of goods is paid for with nine coins."),
         ("BNS_103::chunk_0000", "BNS_103", "Murder", "For murder the price is a whole life.")],
        "chunk_id string, section_id string, title string, text string")
    cat = spark.createDataFrame([("S1", "Legal aid", "free legal services for theft victims", "all")],
                                "scheme_id string, name string, description string, eligibility string")
    qs = spark.createDataFrame([(1, "punishment for theft"), (2, "  ")], "query_id long, question string")
    a = answer(qs, passages, callables.cite_first_block, catalogue=cat, min_score=0.0,
               catalogue_kw=dict(min_score=0.0), passage_id="chunk_id")
    without = answer(qs, passages, callables.cite_first_block, min_score=0.0, passage_id="chunk_id")
    assert a.schema["schemes"].dataType == without.schema["schemes"].dataType
    rows = {r.query_id: r for r in a.collect()}
    assert rows[1].answer == "According to [BNS_303 | Theft]"
    assert [c.section_id for c in rows[1].citations][0] == "BNS_303"
    assert rows[1].schemes[0].id == "S1" and rows[1].schemes[0].fields["name"] == "Legal aid"
    assert len(rows[1].schemes) == 1 and rows[2].citations == [] and rows[2].answer == "No context."
    t = traces(a, {"top_k": 5}).collect()
    assert len(t) == 2 and json.loads(t[0].trace)["answer"] and t[0].params["top_k"] == "5"


def test_hit_flags_judge_totals(spark):
    items = spark.createDataFrame([(1, "q1", "A"), (2, "q2", "B"), (3, "q3", "C")],
                                  "query_id long, question string, expected_section string")
    hits = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "A"), (2, 2, "B")],
                                 "query_id long, rank int, section_id string")
    rows = hit_flags(items, hits)
    got = {r.query_id: (r.in_top_5, r.in_top_1, r.retrieved) for r in rows.collect()}
    assert got == {1: (True, True, ["A", "B"]), 2: (True, False, ["A", "B"]), 3: (False, False, [])}
    rows = rows.withColumn("answer", F.concat(F.lit("According to ["), F.get("retrieved", 0), F.lit(" | t]")))
    judged = judge(rows, callables.rule_judge)
    m = totals(judged).first()
    assert (m.hit_at_5, m.hit_at_1, m.n_examples) == (2 / 3, 1 / 3, 3)
    assert abs(m.judge_correctness_avg - (5 + 1 + 1) / 15) < 1e-12 and abs(m.judge_citation_avg - 1 / 3) < 1e-12
    empty = totals(judged.limit(0)).first()
    assert empty.n_examples == 0 and empty.hit_at_5 is None and empty.judge_correctness_avg is None


def test_question_set_reader(spark, tmp_path):
    doc = {"version": "1.0", "description": "d", "items": [
        {"question": "What is theft?", "expected_section": "BNS_303", "language": "en"},
        {"question": "chori ki saza?", "expected_section": "BNS_303", "language": "hi"}]}
    p = tmp_path / "q.json"
    p.write_text(json.dumps(doc, indent=2))
    rows = read_question_set(spark, str(p)).orderBy("item_ord").collect()
    assert [r.language for r in rows] == ["en", "hi"] and rows[0].expected_section == "BNS_303"


def test_model_encoder_and_vector_build(spark, tmp_path):
    import numpy as np

    from quarry.operators.embed import embed
    from quarry.plans.ingest import build_vectors, corpus_chunks, corpus_profile

    def factory():
        # A stand-in model: letter counts (a..e) as a 5-dim vector.
        return lambda texts: np.array([[t.count(c) for c in "abcde"] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(1, "abc abc"), (2, "eee"), (3, "zzz")], "id long, text string")
    rows = {r.id: r.embedding for r in embed(df, factory, "text", keep=["id"]).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and rows[2] == [0, 0, 0, 0, 1.0] and rows[3] == [0.0] * 5
    texts = spark.createDataFrame([("d1", "Section 1. A\nalpha beta\nSection 2. B\ngamma")], "doc_id string, text string")
    chunks = corpus_chunks(texts, 4, 1)
    m = build_vectors(chunks, str(tmp_path / "vec"))
    assert m.first().ntotal == chunks.count()
    prof = corpus_profile(chunks)
    assert [r.section_id for r in prof["chunks_per_section"].collect()] == ["BNS_1", "BNS_2"]


def test_write_results(spark, tmp_path):
    from quarry.operators.evaluate import write_results
    rows = spark.createDataFrame([(1, True)], "query_id long, in_top_1 boolean")
    write_results(rows, rows.groupBy().count(), str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval/results")).count() == 1


def test_evaluate_end_to_end(spark, tmp_path):
    from quarry.operators.evaluate import evaluate

    passages = spark.createDataFrame(
        [("p1", "BNS_303", "Theft", "Any theft of goods is paid for with nine coins."),
         ("p2", "BNS_103", "Murder", "For murder the price is a whole life.")],
        "passage_id string, section_id string, title string, text string")
    items = spark.createDataFrame([(1, "punishment for theft", "BNS_303"), (2, "murder death", "BNS_999")],
                                  "query_id long, question string, expected_section string")
    rows, metrics = evaluate(items, passages, callables.cite_first_block, callables.rule_judge,
                             str(tmp_path / "e"), min_score=0.0)
    got = {r.query_id: (r.in_top_1, r.judge.citation, r.error, r.judge_error) for r in rows.collect()}
    assert got == {1: (True, 1, None, None), 2: (False, 0, None, None)}
    assert spark.read.json(str(tmp_path / "e/metrics")).first().n_examples == 2


def test_manifest_checks_sparse_sets(spark, tmp_path):
    import pytest

    from quarry.sources.tables import write_manifest

    good = spark.createDataFrame([(1, [0, 63], [0.6, 0.8]), (2, [], [])], "id long, buckets array<int>, weights array<double>")
    assert write_manifest(good, str(tmp_path / "a"), "buckets", dim=64).first().dim == 64
    for bad in ([(1, [64], [1.0])], [(1, [3], [0.5, 0.5])]):
        with pytest.raises(ValueError):
            write_manifest(spark.createDataFrame(bad, good.schema), str(tmp_path / "b"), "buckets", dim=64)
