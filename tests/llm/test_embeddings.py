import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.embeddings import ESTIMATE_TURNS, near_vectors, plan_bands, rotations


def plain(rows):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95] for i in good}
    part = {}
    for i in sorted(good):
        stack = [i] if i not in part else []
        while stack:
            x = stack.pop()
            if x not in part:
                part[x] = i
                stack += links[x]
    return {(i, len(links.get(i, [])), part.get(i, i)) for i, _ in rows}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []
    for _ in range(60):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            v = base / np.linalg.norm(base) + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.05, 0.08])
            out.append((len(out), [float(x) for x in v]))
    out += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15),
            (9004, [None] + [1.0] * 15), (9005, [1.0, 0.0]), (9006, [2.0, 0.0]), (9007, [math.inf] * 16)]
    return out


def test_links_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumn("id", F.lit("a"))
    for block in (512, 4):
        got = near_vectors(df, block_rows=block).collect()
        assert {(r.vec_id, r.n_links, r.component_id) for r in got} == plain(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_copies_floats_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(60, [1.0, 2.0, 3.1]), (None, [1.0, 2.0, 3.0])],
                               "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert got[49].n_links == 50 and got[60].n_links == 50 and got[60].component_id == 0
    assert got[None].n_links == 0 and got[None].component_id is None
    assert near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bands_hold_recall():
    rng = np.random.default_rng(5)
    dim, errors = 32, []
    for k in range(300):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        a, b = rng.standard_normal((2, dim))
        a /= np.linalg.norm(a)
        b = (a + 0.5 * b / np.linalg.norm(b))
        b /= np.linalg.norm(b)
        y = r @ a
        code = np.sign(y) / math.sqrt(dim)
        errors.append(code @ (r @ b) / (code @ y) - a @ b)
    assert abs(np.mean(errors)) < 4 * np.std(errors) / math.sqrt(len(errors))
    turns = rotations(8, ESTIMATE_TURNS).reshape(ESTIMATE_TURNS, 8, 8)
    assert all(np.allclose(t @ t.T, np.eye(8)) for t in turns)
    for n in (10, 10**5, 10**9):
        width, bands = plan_bands(n, 0.95, 1e-4)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** width) ** bands <= 1e-4


def test_repeated_ids_are_vectors_of_their_own(spark):
    near = [math.cos(0.01), math.sin(0.01)]
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (9, near), (10, near), (2, [-1.0, 0.0]), (2, [0.0, -1.0]),
            (1, [-1.0, 0.001]), (5, None)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(5, 2, 5), (5, 0, 5), (9, 2, 5), (10, 2, 5), (2, 1, 1), (2, 0, 1), (1, 1, 1), (5, 0, 5)])
