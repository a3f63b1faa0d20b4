"""Sources: page assembly, source precedence, CSV strings, text files."""
from quarry.sources.documents import assemble_pages, prefer_paged, read_text_files
from quarry.sources.tables import CLAUSE_MAP_COLUMNS, read_csv_strings


def test_assemble_pages_two_levels(spark):
    pages = [(1, p, None if p == 3 else f"p{p}") for p in [5, 0, 3, 1, 2, 4, 9]] + [(2, 0, "only")]
    df = spark.createDataFrame(pages, "doc_id long, page_no long, text string")
    for block in (1, 2, 4096):
        got = {r.doc_id: r.text for r in assemble_pages(df, block_pages=block).collect()}
        assert got == {1: "p0\np1\np2\n\np4\np5\np9", 2: "only"}


def test_prefer_paged(spark):
    paged = spark.createDataFrame([(1, "paged one")], "doc_id long, text string")
    plain = spark.createDataFrame([(1, "plain one"), (2, "plain two")], "doc_id long, text string")
    got = {r.doc_id: (r.origin, r.text) for r in prefer_paged(paged, plain).collect()}
    assert got == {1: ("paged", "paged one"), 2: ("text", "plain two")}


def test_csv_keeps_strings(spark, tmp_path):
    p = tmp_path / "map.csv"
    p.write_bytes(b'"ipc_section","ipc_title","bns_section","bns_title","summary_of_change"\r\n'
                  b'"304A","Snatching","304","Snatching","New"\r\n"N/A","None","111","Organised crime","New"\r\n')
    rows = read_csv_strings(spark, str(p), CLAUSE_MAP_COLUMNS, ordinal="map_ord").orderBy("map_ord").collect()
    assert [r.ipc_section for r in rows] == ["304A", "N/A"] and rows[1].summary_of_change == "New"


def test_text_files_whole_and_newlines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Section 1. A\r\nbody\rmore\n".encode())
    rows = read_text_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].text == "Section 1. A\nbody\nmore\n"


def test_csv_ordinal_follows_the_files(spark, tmp_path):
    """The larger second file is read first; its rows still come last."""
    cols = ["ipc", "title"]
    (tmp_path / "a.csv").write_text("ipc,title\n1,first\n2,second\n")
    (tmp_path / "b.csv").write_text("ipc,title\n1,other\n" + "".join(f"{i},row {i}\n" for i in range(3, 3000)))
    rows = read_csv_strings(spark, str(tmp_path), cols, ordinal="ord").repartition(5)
    assert [r.title for r in rows.orderBy("ord").limit(4).collect()] == ["first", "second", "other", "row 3"]


def test_a_shared_folder_is_asked_for_off_local(spark, monkeypatch):
    import pytest

    from quarry.session import ensure_checkpoint_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Cluster)


def test_bucketed_passages_are_not_shuffled(spark, tmp_path):
    """Hits meet a bucketed passage table without an exchange on its side."""
    from quarry.operators.retrieve import attach_passages
    from quarry.sources import tables as TB

    TB.create_database(spark, "quarry_buckets", str(tmp_path / "db"))
    rows = [(f"p{i:04d}", f"s{i}", None, f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "passage_id string, section_id string, title string, text string")
    TB.write_bucketed(df, "quarry_buckets.passages", "passage_id", 8, str(tmp_path / "table"))
    hits = spark.createDataFrame([(1, "p0003", 0.5), (2, "p0499", 0.7)], "query_id long, hit_id string, score double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach_passages(hits, spark.table("quarry_buckets.passages"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(hit_id") == 1 and plan.count("Exchange") == 1
        assert sorted((r.query_id, r.section_id, r.title) for r in out.collect()) == [(1, "s3", ""), (2, "s499", "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP TABLE IF EXISTS quarry_buckets.passages")
        spark.sql("DROP DATABASE IF EXISTS quarry_buckets CASCADE")
