import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.byte_models import ORDER, count_windows, estimate, score

TEXTS = [(0, 0, "the cat sat on the mat"), (1, 0, "the dog sat on the log"), (2, 1, "a cat is a cat"),
         (3, 0, ""), (4, 1, None), (5, 1, "zebra é zebra zebra"), (6, 0, "the the the the the")]


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries: log p(byte | before)."""
    grams = {order: Counter()}
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        grams[order].update(b[i:i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    disc = {}
    for k, c in grams.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            raw = [i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0.0) for i in (1, 2, 3)]
            disc[k] = [min(max(d, 0.05), i - 0.05) for d, i in zip(raw, (1, 2, 3))]
        else:
            disc[k] = [0.5] * 3

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        same = [v for x, v in grams[k].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        d = disc[k]
        off = lambda v: d[min(v, 3) - 1]
        own = grams[k].get(g, 0)
        return ((own - off(own)) if own else 0.0) / sum(same) + sum(map(off, same)) / sum(same) * p(g[1:])

    return p


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(TEXTS, "id long, class int, text string")


def test_one_class_matches_dictionaries(spark, rows):
    model = estimate(count_windows(rows.filter("class = 0"), "text", "class", 1), 1)
    p = plain_model([t for _, c, t in TEXTS if c == 0], ORDER)
    got = {r.id: (r['__total0'], r['__bytes']) for r in score(rows, model, "text", ["id"], 1).collect()}
    for i, _, t in TEXTS:
        b = b"\0" * (ORDER - 1) + (t or "").encode()
        want = sum(math.log(p(b[j:j + ORDER])) for j in range(len(b) - ORDER + 1))
        assert abs(got[i][0] - want) < 1e-3 and got[i][1] == len((t or "").encode())


def test_two_classes_and_parts(spark, rows):
    model = estimate(count_windows(rows, "text", "class", 2), 2)
    p = [plain_model([t or "" for _, c, t in TEXTS if c == k], ORDER) for k in (0, 1)]
    probe = spark.createDataFrame([(9, "the zebra sat"), (8, None), (7, "é")], "id long, text string")
    got = {r.id: r['__total0'] for r in score(probe, model, "text", ["id"], 2).collect()}
    b = b"\0" * (ORDER - 1) + b"the zebra sat"
    want = sum(math.log(p[1](b[j:j + ORDER])) - math.log(p[0](b[j:j + ORDER])) for j in range(len(b) - ORDER + 1))
    assert abs(got[9] - want) < 1e-3 and got[8] == 0
    parts = {r.id: r['__total0'] for r in score(probe, model, "text", ["id"], 2, max_entries=60).collect()}
    assert parts.keys() == got.keys() and all(abs(parts[i] - got[i]) < 1e-6 for i in got)
    floors = score(probe, model, "text", ["id"], 2, floors=(0.0, 1e9)).filter("id = 9").first()
    assert abs(floors['__total0'] - want) < 1e-3 and floors['__total1'] == 0


def test_empty(spark, rows):
    model = estimate(count_windows(rows.limit(0), "text", "class", 1), 1)
    assert model.count() == 0
    got = score(rows.filter("id = 0"), model, "text", ["id"], 1).first()
    assert abs(got['__total0'] + got['__bytes'] * np.log(256)) < 1e-6
    assert score(rows.limit(0), model, "text", ["id"], 1).count() == 0
    assert count_windows(rows.filter("id = 6"), "text", "class", 1).agg(F.sum("n0")).first()[0] == 19


def test_parts_keep_rows_that_repeat_the_kept_columns(spark, rows):
    model = estimate(count_windows(rows, "text", "class", 2), 2)
    same = rows.unionByName(rows.filter("id in (0, 5)")).withColumn("id", F.when(F.col("id") > 1, F.col("id")))
    for keep in (["class"], ["id"], ["id", "class", "text"]):
        whole = score(same, model, "text", keep, 2, floors=(0.0, 1.0)).collect()
        parts = score(same, model, "text", keep, 2, floors=(0.0, 1.0), max_entries=60).collect()
        assert len(parts) == len(whole) == 9
        key = lambda r: (*map(str, r[:len(keep)]), r["__bytes"], round(r["__total0"], 6), round(r["__total1"], 6))
        assert sorted(map(key, parts)) == sorted(map(key, whole))
