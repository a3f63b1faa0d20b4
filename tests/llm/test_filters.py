"""Toxicity and quality on small made tables."""
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm.byte_models import score
from quarry.llm.quality import quality, trusted
from quarry.llm.toxicity import fold, toxicity, train


def texts(n, seed=0):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ra", "su", "vel", "no"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zwurg", "qixfo"]))
        rows.append((i, " ".join(w), "en", "s"))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = texts(400)
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "ka lo mi", "en", "s"), (7, rows[7][1], "en", "s"),
             (1002, "ka lo mi " * 50_000, "en", "s")]
    labels += [(None, 1, 1), (3, None, None), (999_999, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
            .withColumn("bytes", F.lit("b")),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_held_out_and_edges(spark, tables):
    docs, labels = tables
    model = train(docs, labels)
    out = toxicity(docs, model, ["doc_id", "bytes"]).collect()
    assert len(out) == 405 and all(0 <= r["__score"] <= 1 and r.bytes == "b" for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400
            and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r["__score"] >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert right / len(held) > 0.95
    by = {r.doc_id: r["__score"] for r in out}
    assert by[1000] == by[1001] < 0.5 and by[1002] < 0.5
    assert toxicity(docs.limit(0), model, ["doc_id"]).count() == 0
    assert [r[0] for r in docs.filter("doc_id = 12").select(fold("doc_id")).collect()] == [zlib.crc32(b"12") % 5]


def test_toxicity_without_labels(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity(docs, train(docs, some), ["doc_id"]).filter("__score > 0").count() == 0


def test_quality_rejects_junk_and_keeps_clean(spark):
    rows, _ = texts(500, seed=5)
    rng = random.Random(2)
    junk = [(10_000 + i, "".join(rng.choice("#$%XYZQ|") for _ in range(300)), "en", "s") for i in range(50)]
    edge = [(20_000, None, None, None), (20_001, "", "en", "s"), (20_002, "ka lo", "xx", "s"), (None, "mi ra", None, "s")]
    docs = spark.createDataFrame(rows + junk + edge, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:300]] + [(10_000, 0, 0), (None, 1, 1), (400, None, 0)],
                                   "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert not any(out[r[0]].keep for r in junk)
    assert sum(out[r[0]].keep for r in rows) > 0.94 * len(rows)
    assert all(out[r[0]].keep for r in edge)
    assert quality(docs, labels.limit(0)).filter("not keep").count() == 0
    assert quality(docs.limit(0), labels).count() == 0


def test_models_of_several_parts_keep_repeated_rows(spark, tables, monkeypatch):
    docs, labels = tables
    docs = docs.unionByName(docs.filter("doc_id in (12, 15) or doc_id is null")).drop("bytes")
    monkeypatch.setattr(score, "__defaults__", (*score.__defaults__[:-1], 4000))
    model = train(docs, labels)
    assert model.grams.count() > 4000
    out = toxicity(docs, model, ["doc_id"]).collect()
    assert len(out) == 408
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400
            and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r["__score"] >= 0.5) == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    kept = quality(docs, labels).collect()
    assert len(kept) == 408
    limit = {r.limit for r in kept}
    assert len(limit) == 1 and sum(r.keep for r in kept) > 0.9 * len(kept)


def test_all_trusted_rows_count(spark):
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"),
                                       F.when(F.col("id") < 300, "xx").otherwise("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    n = {r["__lang"]: r["count"] for r in
         trusted(docs, labels, "doc_id", "text", "lang").groupBy("__lang").count().collect()}
    assert n == {"xx": 300, "en": 299_700}
