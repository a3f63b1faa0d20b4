import math

import numpy as np
import pytest

from quarry.llm import negatives as module
from quarry.llm.negatives import Best, Tree, descend, exact_products, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k, m):
    v = []
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label,
                  [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for n, (i, label, x) in enumerate(v):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, z, other) for z, (j, other, y) in enumerate(v)
                  if z != n and len(y) == len(x)]
        same = sorted(s[:3] for s in scored if s[3] == label)[:k]
        for score, j, _ in same:
            low = [s for s in sorted(s[:3] for s in scored if s[3] != label) if 80 * -score <= -100 * s[0] <= -100 * score]
            out += [(i, j, r, z, -score, -s) for r, (s, z, _) in enumerate(low[:m], 1)]
    return sorted(out)


def made(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 4] = x[0]  # many equal vectors
    x[n // 4:n // 3] *= 5  # and long ones
    return [(i, [float(c) for c in np.float32(x[i])], int(rng.integers(0, 4))) for i in range(n)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,tree_rows,anchors", [(1, 40, 3), (2, 4096, 512)])
def test_equals_brute_force(spark, monkeypatch, seed, tree_rows, anchors):
    monkeypatch.setattr(module, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(module, "ANCHORS", anchors)
    rows = made(seed)
    rows += [(None, rows[0][1], 1), (5000, None, 1), (5100, [], 1), (5200, [None] * 8, 1), (5300, [math.nan] * 8, 1),
             (5400, [math.inf] + [0.0] * 7, 2), (5500, [0.0] * 8, 1), (5600, rows[0][1], None), (5700, [1.0, 2.0], 3),
             (5800, [1.0, 1.5], 2), (5900, [1.0, 1.9], 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(hard_negatives(docs, every=20)) == plain(rows, 20, 5, 5)


def test_repeated_ids(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.9, 0.0], 2), (4, [0.9, 0.0], 2),
            (6, [0.0, 1.0], 2)]
    assert found(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == plain(rows, 100, 5, 5)


def test_empty_and_clashing_columns(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = made(3, 60)
    clash = spark.createDataFrame([(*r, 1, 2, b"", 3) for r in rows],
                                  SCHEMA + ", row int, id int, v binary, no int")
    assert found(hard_negatives(clash, every=10)) == plain(rows, 10, 5, 5)


def test_large_components_stay_exact():
    p, q = np.array([[2.0**40 + 1, 3.0], [1.0, 2.0**41]]), np.array([2.0**40 + 1, 5.0])
    assert list(exact_products(p, q)) == [(2**40 + 1) ** 2 + 15, 2**40 + 1 + 5 * 2**41]


def test_tree_skips_and_nothing_is_lost():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    x = np.floor(256 * (centres[rng.integers(0, 40, 3000)] + 0.02 * rng.normal(size=(3000, 12))))
    tree = Tree.unpack(Tree(x, np.arange(3000), np.arange(3000)).pack())
    low, high = tree.bounds(x[7])
    products = tree.points @ x[7]
    for node in range(len(tree.radius)):  # leaves bound what they hold
        a, b = tree.low[node], tree.high[node]
        if b > a:
            assert low[node] <= products[a:b].min() and products[a:b].max() <= high[node]
    best = Best(5)
    seen = descend(tree, x[7], (low, high), best, 7)
    want = sorted((-int(s), int(i)) for s, i in zip(x @ x[7], range(3000)) if i != 7)[:5]
    assert [(-s, i) for s, i, _ in best.hits] == want and seen < 1500
    window = Best(5, 1000, int(best.hits[-1][0] * 0.8))
    descend(tree, x[7], (low, high), window, 7)
    want = sorted((-int(s), int(i)) for s, i in zip(x @ x[7], range(3000)) if 1000 <= s <= window.high and i != 7)[:5]
    assert [(-s, i) for s, i, _ in window.hits] == want
