from pyspark.sql import functions as F

from quarry.llm import ids as ids_module
from quarry.llm.ids import without_ids


def test_without_ids(spark, monkeypatch):
    df = spark.range(3000).withColumn("text", F.concat(F.lit("t"), "id")).unionByName(
        spark.createDataFrame([(None, "null"), (7, None)], "id long, text string"))
    gone = spark.createDataFrame([(i,) for i in range(0, 3000, 7)], "id long")
    want = {(i, f"t{i}") for i in range(3000) if i % 7} | {(None, "null")}
    for bits in (1 << 26, 1 << 10):  # a full filter passes everything to the join
        monkeypatch.setattr(ids_module, "FILTER_BITS", bits)
        out = without_ids(df, gone, "id")
        assert out.columns == df.columns and {tuple(r) for r in out.collect()} == want
    assert without_ids(df, gone.limit(0), "id").count() == 3002
    assert without_ids(df.limit(0), gone, "id").count() == 0
