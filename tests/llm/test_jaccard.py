import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard
from quarry.llm.jaccard import Threshold, boundary, jaccard_components


def plain(rows):
    """All pairs that share a shingle, compared as sets; union-find."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = {}
    for k, (i, s) in enumerate(sets):
        common = {}
        for t in s:
            for j in lists.setdefault(t, []):
                common[j] = common.get(j, 0) + 1
            lists[t].append(k)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j][1]) - c):
                a, b = sorted((find(i), find(sets[j][0])))
                up[b] = a
    return {(i, len(s), find(i)) for i, s in sets}


def made(seed, groups=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    passage = [rng.choice(vocab) + "p" for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 6, 8, 9, 10, 12, 13, 15, 17, 25, 80, 200]))]
        if rng.random() < .3:
            base = base[:10] + passage[:rng.choice([20, 40, 60])] + base[10:]
        for _ in range(rng.choice([1, 1, 2, 3, 6, 15])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    k, op = rng.randrange(len(w)), rng.random()
                    if op < .4:
                        w[k] = rng.choice(vocab)
                    elif op < .7:
                        w.insert(k, rng.choice(vocab))
                    else:
                        w = w[:max(1, len(w) - rng.randrange(6))]
            rows.append((len(rows), " ".join(w) if rng.random() < .98 else None))
    rng.shuffle(rows)
    return rows


def result(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}


@pytest.mark.parametrize("seed,light", [(1, None), (2, 0), (3, 12)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, light):
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == plain(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 1)
    rng = random.Random(4)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == plain(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE "), (6, "a b c d"), (7, "a b c"),
            (8, "long " * 100_000), (9, "long " * 90_000), (9, "long " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")) \
        .withColumn("key", F.lit(1.5))
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert out == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (9, 1, 8)}
    null = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_components(null).collect()} == {(None, None), (3, 3)}
    assert jaccard_components(df.limit(0)).count() == 0


def test_threshold_arithmetic():
    t = Threshold(3, 4)
    for x in range(1, 60):
        for y in range(x, 60):
            least = next((o for o in range(1, x + 1) if 100 * o >= 75 * (x + y - o)), None)
            if least is None:
                assert not t.close(x, y)
            else:
                assert t.close(x, y) and t.overlap(x, y) == least and least in t.needed(x) and least in t.needed(y)
                meet = min(jaccard.TOGETHER, least)
                assert t.together(x, y) == meet
                assert x - least + meet <= t.prefix(x) <= x and y - least + meet <= t.prefix(y) <= y
    assert boundary(t, 1.0) < boundary(t, 1e6) <= jaccard.LIGHT_LIMIT


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, b), (2, a), (2, b), (7, a), (9, "c d e")]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (7, 1), (9, 9)}


def test_sketches_never_rule_out_a_link():
    import numpy as np

    rng, limit = np.random.default_rng(2), Threshold()
    for _ in range(300):
        n = int(rng.integers(4, 400))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = x.copy()
        k = int(rng.integers(0, max(1, n // 3)))
        y[rng.permutation(len(y))[:k]] = rng.integers(0, 2**63, k, dtype=np.uint64)
        y = np.unique(y)
        apart = int(np.bitwise_count((jaccard.sketch(x) ^ jaccard.sketch(y)).view(np.uint64)).sum())
        if len(np.intersect1d(x, y)) >= limit.overlap(len(x), len(y)):
            assert jaccard.may_link(limit, len(x), len(y), apart)


def test_folded_sketches_never_rule_out_a_link(spark):
    import numpy as np

    rng, limit = np.random.default_rng(5), Threshold()
    rows, want = [], []
    for n in (3, 500, 512, 513, 1000, 1024, 1100, 3000, 5000):
        for share in (0.0, 0.1, 0.14, 0.5, 1.0):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[int(n * share):], rng.integers(0, 2**63, int(n * share * 1.2), dtype=np.uint64)]))
            rows.append((len(rows), *[jaccard.sketch(t, jaccard.sketch_bits(len(t))).tolist() for t in (x, y)]))
            want.append((len(x), len(y), len(np.intersect1d(x, y))))
    df = spark.createDataFrame(rows, "i int, x array<long>, y array<long>")
    got = {r.i: r.d for r in df.select("i", jaccard.differing(F.col("x"), F.col("y")).alias("d")).collect()}
    for i, (nx, ny, both) in enumerate(want):
        assert got[i] <= nx + ny - 2 * both
        if both >= limit.overlap(nx, ny):
            assert jaccard.may_link(limit, nx, ny, got[i])
        elif both < (nx + ny) / 4 and nx >= 500:
            assert not jaccard.may_link(limit, nx, ny, got[i])


def test_long_texts_with_a_shared_passage_are_not_compared(spark, monkeypatch):
    """They meet in lists, but their sketches rule them out; long copies link."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(500)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(1100 + i)])) for i in range(12)]
    rows += [(100 + i, t + " x y z") for i, t in rows[:3]]
    sent = []
    verify = jaccard.verify

    def counted(docs, pairs, *rest):
        sent.append(pairs.count())
        return verify(docs, pairs, *rest)

    monkeypatch.setattr(jaccard, "verify", counted)
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)
    assert sum(sent) == 3
