import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.queries import QUERIES
from quarry.session import ensure_checkpoint_dir, materialize, scratch_tables

from tests.conftest import SF_SMALL


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == columns + ["shard"] and 0 < out.count() <= 2 * sizes[0]


def test_one_query_for_each_operator():
    numbers = sorted(int(q[2:].split("_")[0]) for q in QUERIES)
    assert numbers == list(range(1, 14))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0


def test_null_and_repeated_ids(spark):
    """Copies go whatever their ids are, and so do leaks."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(1, one), (None, one), (None, one), (1, one), (2, two), (2, item + " " + two + " x y z"), (None, item), (None, None)]
    made = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], docs.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, made, SF_SMALL).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "")[1:] for r in kept if r.text == one) == [(1, one)]
    assert len(kept) == 5
    left = corpus_pipeline.drop_leaks(spark, made, SF_SMALL).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str(r) for r in rows if item not in (r[1] or ""))
    mixed = corpus_pipeline.mix_sources(spark, made, SF_SMALL)
    assert mixed.columns == docs.columns and mixed.count() <= 2 * len(rows)


def test_extra_columns_with_names_of_the_stages_own(spark):
    """Columns that are called like columns a stage makes stay as they are,
    and do not change which rows stay."""
    plain = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = ["component_id", "score", "copies", "row", "item_id", "size", "target", "toxic", "quality", "place",
             "first", "start", "stop", "n", "id", "key", "slot", "words", "value"]
    wide = plain.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = (materialize(stage(spark, d, SF_SMALL)) for d in (plain, wide))
        own = [c for c in plain.columns]
        assert sorted(map(str, wide.select(own).collect())) == sorted(map(str, plain.collect())), name
        for c in names:
            assert wide.filter(~F.col(c).eqNullSafe(F.concat(F.lit(f"{c} of "), "doc_id"))).isEmpty(), (name, c)


def scratch(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("quarry-table-")}


def test_stages_leave_only_the_tables_that_their_result_reads(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate([one, one, two])],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    before = scratch(spark)
    made = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL)
    assert len(scratch(spark) - before) == 2
    assert sorted(r.doc_id for r in made.collect()) == [0, 2]


def test_scratch_tables_may_be_nested(spark):
    before = scratch(spark)
    with scratch_tables(spark) as outer:
        with scratch_tables(spark) as inner:
            one, two = materialize(spark.range(3)), materialize(spark.range(4))
            inner.keep(one, two)
            materialize(spark.range(5))
            with pytest.raises(ValueError):
                inner.keep(one.filter("id > 0"))
        assert len(scratch(spark) - before) == 2
        outer.keep(two)
    assert two.count() == 4 and len(scratch(spark) - before) == 1
    with pytest.raises(ZeroDivisionError), scratch_tables(spark):
        materialize(spark.range(2))
        1 / 0
    assert len(scratch(spark) - before) == 1
