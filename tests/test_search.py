"""Exact top-k search against brute force, with one and with many question blocks."""
import numpy as np
import pytest

from quarry.operators.embed import build_vector_set, hashed_vectors
from quarry.operators.retrieve import keep_min_score, retrieve
from quarry.operators.search import search


def brute(q, c, k, exclude_self=False):
    out = {}
    for qi, qv in q.items():
        scored = []
        for ci, cv in c.items():
            if exclude_self and ci == qi:
                continue
            scored.append((-round(float(np.dot(qv, cv)), 6), ci))
        scored.sort()
        out[qi] = [(ci, -s) for s, ci in scored[:k]]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.hit_id, r.score))
    return out


def dense_frames(spark, n_q, n_c, dim=8, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    cv = rng.normal(size=(n_c, dim))
    if ties:
        cv = np.round(cv)  # many equal scores
    cv[0] = 0.0  # a zero vector
    qv = rng.normal(size=(n_q, dim))
    c = {i: cv[i] for i in range(n_c)}
    q = {i: qv[i] for i in range(n_q)}
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in c.items()], "doc_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in q.items()], "query_id long, embedding array<double>")
    return q, c, qdf, cdf


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
@pytest.mark.parametrize("ties", [False, True])
def test_dense_matches_brute_force(spark, block_bytes, ties):
    q, c, qdf, cdf = dense_frames(spark, 23, 157, ties=ties)
    got = search(qdf, cdf, 5, kind="dense", block_bytes=block_bytes).collect()
    want = brute(q, c, 5)
    assert as_dict(got) == {k: [(i, pytest.approx(s, abs=1e-6)) for i, s in v] for k, v in want.items()}


def test_k_larger_than_corpus_and_self_exclusion(spark):
    q, c, qdf, cdf = dense_frames(spark, 4, 6)
    got = as_dict(search(cdf.withColumnRenamed("doc_id", "query_id"), cdf, 10, kind="dense",
                         exclude_self=True).collect())
    assert all(len(v) == 5 for v in got.values())
    assert all(qi not in [h for h, _ in v] for qi, v in got.items())


def test_min_score_keeps_best_hit(spark):
    q, c, qdf, cdf = dense_frames(spark, 5, 30)
    hits = search(qdf, cdf, 5, kind="dense")
    kept = keep_min_score(hits, 5, 1e9).collect()
    assert sorted(r.query_id for r in kept) == list(range(5)) and all(r.rank == 1 for r in kept)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_sparse_matches_dense_equivalent(spark, block_bytes):
    texts = ["the cat sat on the mat", "a dog and a cat", "Théft of property", "", "cat cat cat",
             "Any theft of goods is paid for with nine coins", "property of the state"]
    qs = ["cat on mat", "theft", "dog", "state property theft"]
    cdf = hashed_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                         "text", keep=["doc_id"], buckets=64)
    qdf = hashed_vectors(spark.createDataFrame(list(enumerate(qs)), "query_id long, text string"),
                         "text", keep=["query_id"], buckets=64)

    def dense(rows, key):
        out = {}
        for r in rows:
            v = np.zeros(64)
            for b, w in zip(r.buckets, r.weights):
                v[b] = w
            out[r[key]] = v
        return out
    c, q = dense(cdf.collect(), "doc_id"), dense(qdf.collect(), "query_id")
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for i, v in c.items() if texts[i])
    got = search(qdf, cdf, 3, kind="sparse", block_bytes=block_bytes).collect()
    want = brute(q, c, 3)
    assert as_dict(got) == {k: [(i, pytest.approx(s, abs=1e-6)) for i, s in v] for k, v in want.items()}


def test_retrieve_blank_question_and_empty_corpus(spark):
    p = spark.createDataFrame([("c1", "theft of goods"), ("c2", "murder")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "   "), (2, None), (3, "theft")], "query_id long, question string")
    rows = retrieve(q, p, 5, 0.55, passage_id="chunk_id").collect()
    assert {r.query_id for r in rows} == {3}
    with pytest.raises(ValueError):
        build_vector_set(p.limit(0), "chunk_id")


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_raw_text_corpus_equals_stored_vectors(spark, block_bytes):
    texts = ["the cat sat on the mat", "a dog and a cat", None, "", "cat cat cat", "state property theft"]
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cv = hashed_vectors(raw, "text", keep=["doc_id"], buckets=64)
    qdf = hashed_vectors(spark.createDataFrame([(0, "cat on mat"), (1, "theft")], "query_id long, text string"),
                         "text", keep=["query_id"], buckets=64)
    a = search(qdf, cv, 3, kind="sparse", block_bytes=block_bytes).collect()
    b = search(qdf, raw, 3, kind="sparse", corpus_text="text", buckets=64, block_bytes=block_bytes).collect()
    assert as_dict(a) == as_dict(b)


def test_no_questions_gives_no_rows(spark):
    q, c, qdf, cdf = dense_frames(spark, 3, 10)
    assert search(qdf.limit(0), cdf, 5, kind="dense").collect() == []
    p = spark.createDataFrame([("c1", "theft")], "chunk_id string, text string")
    blank = spark.createDataFrame([(1, " ")], "query_id long, question string")
    assert retrieve(blank, p, 5, 0.5, passage_id="chunk_id").collect() == []


def test_catalogue_null_column_and_no_fallback(spark):
    from quarry.operators.retrieve import match_catalogue

    cat = spark.createDataFrame([("S1", "Legal aid", None, "theft victims"), ("S2", "Farm support", "seeds", None)],
                                "scheme_id string, name string, description string, eligibility string")
    qs = spark.createDataFrame([(1, "legal aid for theft victims"), (2, "zebra")], "query_id long, question string")
    rows = match_catalogue(qs, cat, 3, 0.25).collect()
    assert [(r.query_id, r.hit_id) for r in rows] == [(1, "S1")] and rows[0].description is None
    assert match_catalogue(qs, cat, 3, 0.99).collect() == []


def test_question_without_a_shared_term_keeps_the_smallest_passage(spark):
    p = spark.createDataFrame([("c2", "theft of goods"), ("c1", "murder")], "passage_id string, text string")
    q = spark.createDataFrame([(1, "zebra")], "query_id long, question string")
    assert [(r.hit_id, r.score, r["rank"]) for r in retrieve(q, p, 2, 0.55).collect()] == [("c1", 0.0, 1)]


def test_k_above_the_number_of_passages(spark):
    p = spark.createDataFrame([("c1", "theft"), ("c2", "theft theft")], "passage_id string, text string")
    q = spark.createDataFrame([(1, "theft")], "query_id long, question string")
    assert [r.hit_id for r in retrieve(q, p, 50, 0.1).orderBy("rank").collect()] == ["c1", "c2"]


def test_repeated_section_and_chunk_ids_give_k_hits(spark):
    from quarry.plans.ingest import corpus_chunks

    texts = spark.createDataFrame([(d, f"Section 1. A\ntheft of item{d}\nSection 2. B\nmurder in place{d}\n"
                                       "Section 2. C\nagain") for d in range(5)], "doc_id long, text string")
    chunks = corpus_chunks(texts)
    assert chunks.select("chunk_id").distinct().count() == 2 and chunks.select("passage_id").distinct().count() == 15
    q = spark.createDataFrame([(1, "theft of item3")], "query_id long, question string")
    rows = retrieve(q, chunks, 5, 0.0, attach=["doc_id", "text"]).orderBy("rank").collect()
    assert len(rows) == 5 and rows[0].hit_id == "3#0.0" and "item3" in rows[0].text


def letters():
    return lambda texts: [[float(t.count(c)) for c in "abcdefgh"] for t in texts]


def test_dense_retrieval_with_stored_and_fresh_vectors(spark, tmp_path):
    from quarry.operators.retrieve import catalogue_vectors, match_catalogue
    from quarry.plans.ingest import build_vectors, load_vectors

    p = spark.createDataFrame([("p1", "aaa"), ("p2", "bbb"), ("p3", "aab"), ("p4", None)], "passage_id string, text string")
    build_vectors(p, str(tmp_path / "v"), encoder_factory=letters)
    stored = load_vectors(spark, str(tmp_path / "v"))[0]
    q = spark.createDataFrame([(1, "a a"), (2, "b")], "query_id long, question string")
    for vectors in (None, stored):
        rows = retrieve(q, p, 2, 0.5, vectors=vectors, encoder_factory=letters, attach=["text"]).collect()
        assert sorted((r.query_id, r["rank"], r.hit_id) for r in rows) == [(1, 1, "p1"), (1, 2, "p3"), (2, 1, "p2")]
    with pytest.raises(ValueError):
        retrieve(q, p, vectors=stored)
    cat = spark.createDataFrame([("S1", "aaaa", "", ""), ("S2", "hhhhhhhhh", "", "")],
                                "scheme_id string, name string, description string, eligibility string")
    kept = catalogue_vectors(cat, encoder_factory=letters)
    rows = match_catalogue(q.filter("query_id = 1"), cat, 3, 0.4, vectors=kept, encoder_factory=letters).collect()
    assert [r.hit_id for r in rows] == ["S1"]


def test_counted_bytes_bound_what_is_built(spark):
    """The bytes that questions are counted with bound the block built from
    them, and no question matrix exceeds its limit."""
    from pyspark.sql import functions as F
    from quarry.operators import search as module

    texts = [(i, " ".join(f"t{(i * 31 + j * 7) % 5000}" for j in range(12))) for i in range(3000)]
    q = hashed_vectors(spark.createDataFrame(texts, "query_id long, text string"), "text", keep=["query_id"])
    counted = q.agg(F.sum(module._question_bytes(q, "sparse"))).first()[0]
    prep = module._prepared(q.toArrow(), "sparse")
    assert module.built_bytes(prep) <= counted
    parts = list(module.sub_blocks(prep))
    assert len(parts) > 1 and sum(len(p["ids"]) for p in parts) == len(texts)
    assert all(p["q"].size <= module._MATRIX_CELLS for p in parts)
    dense = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], "query_id long, embedding array<double>")
    counted = dense.agg(F.sum(module._question_bytes(dense, "dense"))).first()[0]
    assert module.built_bytes(module._prepared(dense.toArrow(), "dense")) <= counted


def test_grid_reads_the_corpus_once_and_collects_no_question(spark, monkeypatch):
    """Beyond one block nothing is broadcast or fetched by the driver, and the
    plan has one scan of the corpus."""
    def refuse(self, *a):
        raise AssertionError("questions were fetched")

    q, c, qdf, cdf = dense_frames(spark, 40, 90)
    monkeypatch.setattr(type(qdf), "toPandas", refuse)
    monkeypatch.setattr(type(qdf), "toArrow", refuse)
    hits = search(qdf, cdf, 3, kind="dense", block_bytes=500)
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "__cell" in plan and "BroadcastExchange" not in plan
    monkeypatch.undo()
    assert as_dict(hits.collect()) == {k: [(i, pytest.approx(s, abs=1e-6)) for i, s in v]
                                       for k, v in brute(q, c, 3).items()}
