"""What a search copies and holds does not grow with its number of blocks."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import index, search as module
from quarry.operators.embed import hashed_vectors, text_slices
from quarry.operators.index import build_index, index_search
from quarry.operators.search import search


def rows(df):
    return sorted((r.query_id, r["rank"], r.hit_id, round(r.score, 6)) for r in df.collect())


def texts(n, seed, words=400):
    rng = random.Random(seed)
    return [" ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(9)) for _ in range(n)]


@pytest.fixture
def shapes(monkeypatch):
    seen = []

    def noted(left, right, left_key, right_key, rows, columns, real=module.grid):
        seen.append((rows, right.columns))
        return real(left, right, left_key, right_key, rows, columns)

    monkeypatch.setattr(module, "grid", noted)
    monkeypatch.setattr(index, "grid", noted)
    return seen


def test_small_blocks_do_not_copy_the_corpus(spark, shapes):
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)))],
                              "vec_id long, embedding array<float>")
    names = dict(question_id="vec_id", corpus_id="vec_id", exclude_self=True)
    assert rows(search(e, e, 3, block_bytes=500, **names)) == rows(search(e, e, 3, **names))
    assert [r for r, _ in shapes] == [1]


def test_many_groups_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(1500, 4)), 1)
    v[100:400] = v[7]  # many equal scores
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    names = dict(question_id="vec_id", corpus_id="vec_id", exclude_self=True)
    monkeypatch.setattr(module, "CELL_BYTES", 20_000)
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -np.inf)
    want = sorted((i, r + 1, int(j), round(float(s[i, j]), 6)) for i in range(len(v))
                  for r, j in enumerate(np.lexsort((np.arange(len(v)), -s[i]))[:4]))
    assert rows(search(e, e, 4, block_bytes=9_000, **names)) == want == rows(search(e, e, 4, **names))


def test_texts_of_one_group_are_not_encoded_before_the_grid(spark, shapes):
    c = spark.createDataFrame(list(enumerate(texts(200, 1))), "doc_id long, text string")
    q = hashed_vectors(spark.createDataFrame(list(enumerate(texts(30, 2))), "query_id long, text string"), "text", keep=["query_id"])
    got = search(q, c, 3, kind="sparse", corpus_text="text", block_bytes=600)
    assert shapes == [(1, ["c0", "c1"])]  # id and text
    assert rows(got) == rows(search(q, hashed_vectors(c, "text", keep=["doc_id"]), 3, kind="sparse"))


def test_single_precision_only_chooses():
    """Scores that differ by less than single precision are ranked by the exact ones."""
    v = np.array([[1.0, 0.0, 1e-6 * i] for i in range(9)] * 200)[:1500]
    prep = module.prepare_questions(np.arange(2), "dense", dense=[1.0, 0.0, 1.0, 0.5, 0.25, 3.0])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1500)), pa.ListArray.from_arrays(
        pa.array(np.arange(0, 4501, 3), pa.int32()), pa.array(v.ravel()))], names=["a", "b"])
    got = pa.Table.from_batches(module.best_of(prep, [batch.slice(i, 100) for i in range(0, 1500, 100)], "dense", 5, False))
    s = np.round(v @ prep["q"].T, 6)
    for q in range(2):
        best = np.lexsort((np.arange(1500), -s[:, q]))[:5].tolist()
        assert [h for i, h in zip(got["query_id"].to_pylist(), got["hit_id"].to_pylist()) if i == q] == best


def test_many_questions_meet_an_index(spark, shapes):
    """More questions than are probed one by one, some without any shared term."""
    c = hashed_vectors(spark.createDataFrame([(f"p{i:04d}", t) for i, t in enumerate(texts(700, 5) + ["", "lonely"])],
                                             "passage_id string, text string"), "text", keep=["passage_id"])
    q = hashed_vectors(spark.createDataFrame(list(enumerate(texts(1500, 6) + ["zebra", "", "lonely w1"])),
                                             "query_id long, text string"), "text", keep=["query_id"])
    built = build_index(c.coalesce(2), "passage_id", 150)
    want = rows(search(q, c, 3, kind="sparse", corpus_id="passage_id"))
    assert rows(index_search(q, built, 3)) == want
    assert rows(index_search(q, built, 3, block_bytes=5_000)) == want
    assert [r for r, _ in shapes] == [1]


def test_segments_have_bounded_bytes(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(1200)) for i in range(1100)]
    v = hashed_vectors(spark.createDataFrame(list(enumerate(words)), "passage_id long, text string").coalesce(1),
                       "text", keep=["passage_id"])
    got = index.store_index(build_index(v)).selectExpr("size(ids) n", "octet_length(weight) / 8 w").collect()
    assert sum(r.n for r in got) == 1100 and len(got) > 1 and max(r.w for r in got) <= index.SEGMENT_ENTRIES


def test_texts_are_encoded_in_slices_of_bounded_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 10, "c" * 50, "", "d" * 9])], names=["i", "t"])
    got = [s.column(0).to_pylist() for s in text_slices(batch, 1, 20)]
    assert got == [[0, 1, 2], [3], [4, 5]]


def test_every_cell_of_a_grid_is_a_task(spark):
    """No task holds two cells, and none is without one."""
    left = spark.range(300).select(F.col("id").alias("q0"))
    right = spark.range(900).select(F.col("id").alias("c0"))
    for shape in ((1, 24), (5, 7)):
        met = module.grid(left, right, F.col("q0"), F.col("c0"), *shape)
        tasks = met.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("__cell").alias("n")).collect()
        assert len(tasks) == shape[0] * shape[1] and {t.n for t in tasks} == {1}


def test_passages_of_a_segment_are_scored_in_bounded_runs(spark, monkeypatch):
    """More than a few questions are scored together, some passages at a time."""
    p = hashed_vectors(spark.createDataFrame([(f"p{i:04d}", t) for i, t in enumerate(texts(900, 7))],
                                             "passage_id string, text string"), "text", keep=["passage_id"])
    q = hashed_vectors(spark.createDataFrame(list(enumerate(texts(index.FEW + 10, 8) + ["zebra"])),
                                             "query_id long, text string"), "text", keep=["query_id"])
    batches = build_index(p.coalesce(1), "passage_id").toArrow().to_batches()
    prep = module._prepared(q.select("query_id", "buckets", "weights").toArrow(), "sparse")
    seen = []

    def noted(self, n, mine, *args, real=index.Block.score):
        seen.append(n * max(self.n, len(mine)))
        return real(self, n, mine, *args)

    monkeypatch.setattr(index.Block, "score", noted)
    monkeypatch.setattr(index, "_RUN_CELLS", 30_000)
    got = pa.Table.from_batches(index.best_hits(prep, batches, 3)).to_pylist()
    assert len(seen) > 5 and max(seen) <= 30_000
    want = {(r.query_id, r.hit_id, round(r.score, 6))
            for r in search(q, p, 3, kind="sparse", corpus_id="passage_id").collect()}
    assert {(r["query_id"], r["hit_id"], round(r["score"], 6)) for r in got} == want


def test_questions_without_a_near_passage_are_left_out_of_a_tile():
    """Ties at the bar, scores below it and NaN, offered tile by tile."""
    rng = np.random.default_rng(9)
    s = np.round(rng.normal(size=(600, 40)), 1)
    s[300:, 5:] -= 3.0
    s[400, 2] = np.nan
    best = module.Best(np.arange(40), 4)
    for lo in range(0, 600, 60):
        best.offer(np.arange(lo, lo + 60), s[lo:lo + 60])
    got = best.hits().sort_values(["query_id", "score", "hit_id"], ascending=[True, False, True])
    s[400, 2] = -np.inf
    for j in range(40):
        assert got[got.query_id == j].hit_id.tolist() == np.lexsort((np.arange(600), -s[:, j]))[:4].tolist()
