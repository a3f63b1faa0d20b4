import hashlib

from pyspark.sql import functions as F

from quarry.llm.warc import archive_pages, parse_records, read_archive, record_text, write_archive
from quarry.session import scratch_path

PAGES = [(5, "http://a/", "x" * 200), (3, None, "x" * 200), (9, "http://b/\r\nX: y", "x" * 200),
         (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
         (7, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é中\U0001F600" * 40),
         (8, "u", "y" * 99), (10, "u", "y" * 99), (11, "u", "z" * 100), (12, "u", "z" * 100),
         (12, "u", "z" * 100), (None, "u", "z" * 100), (None, "u", "q" * 150), (20, "u", "q" * 150),
         (30, "u", "long " * 300_000)]


def test_round_trip_and_revisits(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3) \
        .withColumn("digest", F.lit(1)).withColumn("file", F.lit("f"))
    out = archive_pages(spark, df).collect()
    assert len(out) == len(PAGES)
    want = sorted(str((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()))
                  for p, _, h in PAGES)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest)) for r in out) == want
    kinds = {}
    for r in out:
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert kinds[3] == [("response", None)] and kinds[5] == kinds[9] == [("revisit", 3)]
    assert all(kinds[k] == [("response", None)] for k in (1, 2, 4, 6, 7, 8, 10, 11, 20, 30))
    assert kinds[12] == [("revisit", 11)] * 2
    assert sorted(kinds[None], key=str) == [("revisit", 11), ("revisit", 20)]
    assert next(r.url for r in out if r.page_id == 9) == "http://b/%0D%0AX: y"


def test_repeated_original_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "a" * 100)] * 3, "page_id long, url string, html string")
    assert sorted(r.record_type for r in archive_pages(spark, df).collect()) == ["response", "revisit", "revisit"]
    assert archive_pages(spark, df.limit(0)).count() == 0


def test_files_hold_valid_records_of_bounded_bytes(spark):
    import gzip
    import re

    path, bound = scratch_path(spark, "t"), 300_000
    pages = [(i, "u", "p" * (i * 40 % 9000)) for i in range(400)] + [(1000 + i, "u", "big " * 12_000) for i in range(20)] \
        + [(2000, "u", "huge " * 200_000), (2001, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    write_archive(df.select(record_text(F.col("page_id"), F.col("url"), F.col("html"), F.lit("00"),
                                        F.lit(None).cast("string"), F.lit("2024-01-02T03:04:05Z"))), path, bound)
    files = [bytes(f.content) for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect()]
    records = [list(parse_records(f)) for f in files]
    assert sum(map(len, records)) == len(pages)
    assert all(len(gzip.decompress(f)) <= bound for f, r in zip(files, records) if len(r) > 1)
    for _, fields, _ in sum(records, []):
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
    got = {(r.page_id, r.payload, r.date) for r in read_archive(spark, path, payload=True).collect()}
    assert got == {(str(p), h or "", "2024-01-02T03:04:05Z") for p, _, h in pages}
