import re

import pytest
from pyspark.sql import functions as F

from quarry.llm.mixing import mix, source_targets, word_count


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Reshare the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: left * w[s] / total for s in open_}}
        for s in over:
            fixed[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 10, "c": 0}, {"é": 3, "z": 3, "Z": 3, "": 9, "m": 400}])
def test_targets_by_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mix_takes_near_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 40), "s%d" % (0 if i % 3 else i % 7)) for i in range(3000)]
    rows += [(5000, None, "s1"), (5001, "", None), (None, "a b", None), (5002, " \t\n", "s2"), (7, "w w", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 3000, 4)] + [(8, 1), (None, 1), (9, None)],
                                   "doc_id long, quality int")
    out = mix(docs, labels)
    got = out.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        biggest = max(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= biggest / 2 + 1e-6
        assert rs[0].source_size == sum(r["size"] for r in rs)
        full = int(rs[0].target // rs[0].source_size) if rs[0].source_size else 0
        assert all(r.copies in (full, full + 1) for r in rs)
    again = mix(docs.repartition(7), labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(docs.limit(0), labels).count() == 0


def test_good_documents_are_preferred(spark):
    docs = spark.createDataFrame([(i, "w w w", "abc"[i % 3]) for i in range(4200)],
                                 "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, (i // 3) % 2) for i in range(4200)], "doc_id long, quality int")
    out = mix(docs, labels).join(labels, "doc_id").filter("source = 'c'")
    share = {r.quality: r.s for r in out.groupBy("quality").agg(F.avg("copies").alias("s")).collect()}
    assert share[1] > share[0] * 1.2


def test_word_count(spark):
    texts = ["a b\tc\n d", "", None, "\xa0x\x0b\x0cy", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
