import random

from quarry.llm.components import components


def plain(edges):
    up = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {(x, find(x)) for x in up if find(x) != x}


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    star = [(500, 500 + i) for i in range(1, 200)]
    loose = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)]
    edges = path + star + loose + [(7, 7), (None, 3), (3, None), (1, 0), (0, 1)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "p long, q long")
    for task_edges in (250_000, 100, 7):
        assert {tuple(r) for r in components(df, "p", "q", task_edges).collect()} == plain(edges)
    assert components(df.limit(0), "p", "q").count() == 0
