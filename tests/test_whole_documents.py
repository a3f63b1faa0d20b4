"""Documents keep their identity through text files, and tables may be folders of files."""
import pytest
from pyspark.sql import functions as F

from quarry.plans import io_checks
from quarry.plans.registry import ORACLE
from quarry.sources.documents import read_text_files, split_documents, write_text_files

TEXTS = ["one\r\ntwo\rthree\n", "ends with\r", "", None, "marks \x1e \x1f \x1b \x1be \x1bf \x1b0", "\x1b0", " \n", "ñ\n\n"]


def test_documents_come_back_from_text_files(spark, tmp_path):
    rows = [(i % 6 if i != 5 else None, t) for i, t in enumerate(TEXTS)]
    write_text_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "t"), docs_a_file=3)
    files = read_text_files(spark, str(tmp_path / "t"))
    assert files.count() == 3
    got = [(r.doc_id, r.text) for r in split_documents(files).collect()]
    want = [(None if k is None else str(k), t if t is None else t.replace("\r\n", "\n").replace("\r", "\n")) for k, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_file_gives_no_document(spark, tmp_path):
    write_text_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert split_documents(read_text_files(spark, str(tmp_path / "t"))).count() == 0


def write(spark, sf, name, rows, schema, files=3):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{sf}/{name}.parquet")


def test_text_scan_returns_every_document(spark, tmp_path):
    write(spark, tmp_path, "documents", list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in io_checks.text_scan(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else t.replace("\r\n", "\n").replace("\r", "\n") for i, t in enumerate(TEXTS)}
    assert "GROUP BY" not in ORACLE["text_scan"]


def test_ingest_keeps_every_conversation_a_document(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "model", f"text {c}.{t}") for c in range(230) for t in range(1, 4)]
    write(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")
    got = io_checks.ingest_corpus(spark, str(tmp_path)).select("doc_id", "section_ord", "section_id").collect()
    assert sorted(map(tuple, got)) == [(c, t - 1, f"BNS_{t}") for c in range(230) for t in range(1, 4)]


@pytest.mark.parametrize("folder", [True, False])
def test_streams_read_tables_of_one_or_many_files(spark, tmp_path, folder):
    if folder:
        write(spark, tmp_path, "documents", [(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    else:
        import pandas as pd

        pd.DataFrame({"doc_id": range(20), "text": [f"text {i}" for i in range(20)]}).to_parquet(tmp_path / "documents.parquet")
    write(spark, tmp_path, "labels", [(1, "x")], "doc_id long, text string")  # another table beside it
    got = io_checks.stream_chunks(spark, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(i, f"text {i}") for i in range(20)]
