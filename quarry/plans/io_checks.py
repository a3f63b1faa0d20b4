"""Sources, sinks and streams: round trips through the shared checkpoint
folder (``spark.checkpoint.dir``), read back by the returned DataFrame."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.answers import answer, append_traces, generate_once
from quarry.operators.retrieve import retrieve
from quarry.plans import callables
from quarry.plans import sql as S
from quarry.plans.corpus_checks import SECTION_OVERLAP, SECTION_TOKENS, conversation_statutes
from quarry.plans.ingest import build_vectors, ingest, update_vectors
from quarry.plans.corpus_checks import DOC_CHUNKS_SQL, DOC_OVERLAP, DOC_TOKENS
from quarry.plans.registry import register, table
from quarry.plans.search_checks import TEXT_HITS_SQL, TEXT_K, TEXT_MIN, passages
from quarry.session import materialize, scratch_path
from quarry.sources import tables as TB
from quarry.sources.documents import read_text_files, split_documents, write_text_files
from quarry.sources.large_texts import read_large_sections
from quarry.streaming.streams import (answer_repeats, answer_stream, answers_with_traces, chunk_stream, file_stream,
                                      first_questions)

SUPPLIER_COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def _typed(df):
    return df.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"),
                     F.col("s_acctbal").cast("double"))


@register("table_roundtrip", " UNION ALL ".join(
    f"SELECT '{fmt}' AS fmt, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
    for fmt in ("csv", "json", "parquet", "table")))
def table_roundtrip(spark, sf):
    src = table(spark, sf, "supplier").select(*SUPPLIER_COLS)
    base = scratch_path(spark, "roundtrip")
    TB.write_csv(src, f"{base}/csv")
    TB.write_json(src, f"{base}/json")
    TB.write_parquet(src, f"{base}/parquet")
    db = "quarry_roundtrip"
    TB.create_database(spark, db, f"{base}/warehouse")
    name = f"{db}.supplier_{base.rsplit('-', 1)[-1]}"
    TB.write_table(src, name, "parquet", path=f"{base}/table")
    csv = _typed(TB.read_csv_strings(spark, f"{base}/csv", SUPPLIER_COLS))
    js = _typed(spark.read.schema(src.schema).json(f"{base}/json"))
    pq = TB.read_parquet(spark, f"{base}/parquet")
    tb = TB.read_table(spark, name).select(*SUPPLIER_COLS)
    parts = [d.select(F.lit(f).alias("fmt"), *SUPPLIER_COLS) for f, d in
             (("csv", csv), ("json", js), ("parquet", pq), ("table", tb))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("text_scan", """
SELECT doc_id, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') AS text FROM documents
""")
def text_scan(spark, sf):
    """Every document through text files: files of a bounded number of
    documents, each read whole, and their documents again."""
    base = scratch_path(spark, "texts")
    write_text_files(table(spark, sf, "documents").select("doc_id", "text"), base)
    return split_documents(read_text_files(spark, base)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@register("stream_chunks", f"SELECT doc_id, section_id, chunk_id, chunk_index, text FROM {DOC_CHUNKS_SQL}")
def stream_chunks(spark, sf):
    schema = table(spark, sf, "documents").schema
    base = scratch_path(spark, "stream-chunks")
    docs = file_stream(spark, sf, schema, glob="documents.parquet")
    q = chunk_stream(docs, f"{base}/sink", f"{base}/checkpoint", DOC_TOKENS, DOC_OVERLAP)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("stream_answers", f"""
SELECT h.query_id AS item_id, h.rank, h.hit_id AS chunk_id, c.doc_id, h.score
FROM {TEXT_HITS_SQL} h JOIN {DOC_CHUNKS_SQL} c ON c.chunk_id = h.hit_id
""")
def stream_answers(spark, sf):
    schema = table(spark, sf, "benchmark").schema
    base = scratch_path(spark, "stream-answers")
    pas = passages(spark, sf)
    # The passage vectors are built once (a stored table), not per batch.
    build_vectors(pas, f"{base}/index", id_col="chunk_id")
    vecs = spark.read.parquet(f"{base}/index/vectors")

    def rank(batch):
        q = batch.select("item_id", F.col("text").alias("question"))
        hits = retrieve(q, pas, TEXT_K, TEXT_MIN, question_id="item_id", question_text="question",
                        passage_id="chunk_id", attach=["doc_id"], vectors=vecs)
        return hits.select(
            F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"),
            F.col("hit_id").alias("chunk_id"), "doc_id", "score")

    qs = file_stream(spark, sf, schema, glob="benchmark.parquet")
    answer_stream(qs, rank, f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/sink").drop("batch_id")


@register("ingest_corpus", f"""
SELECT doc_id, section_ord, title, section_id, chunk_id, chunk_index, text
FROM {S.char_chunks(S.section_rows(), "section_id", "text", SECTION_TOKENS, SECTION_OVERLAP,
                    extra="doc_id, section_ord, title")}
""")
def ingest_corpus(spark, sf):
    """Q-1 end to end: every statute text written into text files, ingested
    (read whole, sectioned, chunked, written) as a document of its own, read
    back."""
    base = scratch_path(spark, "ingest")
    write_text_files(conversation_statutes(spark, sf), f"{base}/texts")
    out = ingest(spark, f"{base}/texts", f"{base}/out", chunk_tokens=SECTION_TOKENS, overlap=SECTION_OVERLAP, packed=True)
    return spark.read.parquet(out["chunks"]).select(
        F.col("doc_id").cast("long"), F.col("section_ord").cast("long"), "title", "section_id", "chunk_id",
        F.col("chunk_index").cast("long"), "text")


@register("large_text_sections", f"SELECT section_id, title, text FROM {S.section_rows()}")
def large_text_sections(spark, sf):
    """Statutes written into a few long text files, each read by byte ranges
    and split into the sections of the whole."""
    base = scratch_path(spark, "large-texts")
    (conversation_statutes(spark, sf).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
     .select("text").write.text(base))
    return read_large_sections(spark, base, chunk_bytes=1 << 16).select("section_id", "title", "text")


# Questions of the trace query: their answers cite the first passage.
_TRACE_SQL = f"""
WITH m AS (SELECT h.query_id, h.rank, h.hit_id, c.section_id, coalesce(d.source, '') AS title
           FROM {TEXT_HITS_SQL} h JOIN {DOC_CHUNKS_SQL} c ON c.chunk_id = h.hit_id
           JOIN documents d ON d.doc_id = c.doc_id),
c AS (SELECT query_id, count(*) AS n, string_agg(hit_id, ',' ORDER BY rank) AS ids,
             arg_min('According to [' || section_id || ' | ' || title || ']', rank) AS answer
      FROM m GROUP BY query_id)
SELECT b.item_id, CAST(coalesce(c.n, 0) AS DOUBLE) AS n_citations, CAST(0 AS DOUBLE) AS n_schemes,
       'min_score=0.55,top_k=5' AS params, b.text AS question, coalesce(c.answer, 'No context.') AS answer,
       coalesce(c.ids, '') AS citation_ids
FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id
"""


def _trace_rows(t):
    trace = F.from_json("trace", "question string, answer string, citations array<struct<chunk_id:string>>")
    params = F.array_join(F.transform(F.array_sort(F.map_entries("params")),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return t.withColumn("t", trace).select(
        F.substring_index("run_id", "-", -1).cast("long").alias("item_id"),
        F.col("metrics")["n_citations"].alias("n_citations"), F.col("metrics")["n_schemes"].alias("n_schemes"),
        params.alias("params"), F.col("t.question").alias("question"), F.col("t.answer").alias("answer"),
        F.array_join("t.citations.chunk_id", ",").alias("citation_ids"))


@register("trace_log", _TRACE_SQL)
def trace_log(spark, sf):
    """Answer records appended as trace rows (params, metrics, nested JSON
    trace) to a table folder, read back."""
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    a = answer(q, passages(spark, sf), callables.cite_first_block, question_id="item_id",
               question_text="question", passage_id="chunk_id")
    path = scratch_path(spark, "traces")
    a = materialize(a)
    for _ in range(2):  # the same batch again leaves nothing twice
        append_traces(a, path, {"top_k": TEXT_K, "min_score": TEXT_MIN}, question_id="item_id")
    return _trace_rows(spark.read.parquet(path))


@register("stream_traces", _TRACE_SQL)
def stream_traces(spark, sf):
    """The same from a stream: each micro-batch is answered and traced."""
    schema = table(spark, sf, "benchmark").schema
    base = scratch_path(spark, "stream-traces")
    qs = file_stream(spark, sf, schema, glob="benchmark.parquet").withColumnRenamed("text", "question")
    pas = passages(spark, sf)
    build_vectors(pas, f"{base}/index", id_col="chunk_id")  # once, not per batch
    answers_with_traces(qs, pas, callables.cite_first_block, f"{base}/sink", f"{base}/checkpoint",
                        {"top_k": TEXT_K, "min_score": TEXT_MIN}, question_id="item_id", passage_id="chunk_id",
                        vectors=spark.read.parquet(f"{base}/index/vectors")).awaitTermination()
    return _trace_rows(spark.read.parquet(f"{base}/sink"))


@register("vector_update", """
WITH d AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS passage_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS passage_id, coalesce(text, '') AS text FROM benchmark)
SELECT 'documents' AS build, count(*) AS ntotal, count(DISTINCT text) AS n_encoded FROM d
UNION ALL
SELECT 'both' AS build, (SELECT count(*) FROM d) + (SELECT count(*) FROM b) AS ntotal,
       (SELECT count(DISTINCT text) FROM (SELECT text FROM d UNION ALL SELECT text FROM b)) AS n_encoded
UNION ALL
SELECT 'benchmark' AS build, (SELECT count(*) FROM b) AS ntotal,
       (SELECT count(DISTINCT text) FROM (SELECT text FROM d UNION ALL SELECT text FROM b)) AS n_encoded
""")
def vector_update(spark, sf):
    """A vector set that follows its passages: documents, then benchmark items
    as well, then these alone; each text is encoded once."""
    base = scratch_path(spark, "vector-update")
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("passage_id"), "text")
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("passage_id"), "text")
    out = None
    for name, chunks in (("documents", docs), ("both", docs.unionByName(items)), ("benchmark", items)):
        update_vectors(chunks, base)
        encoded = F.lit(spark.read.parquet(f"{base}/encoded").count()).cast("long").alias("n_encoded")
        state = materialize(spark.read.json(f"{base}/manifest").select(F.lit(name).alias("build"), "ntotal", encoded))
        out = state if out is None else out.unionByName(state)
    return out


@register("generate_ledger", f"""
SELECT item_id, {S.strip("coalesce(text, '')")} AS answer,
       (SELECT count(DISTINCT coalesce(text, '')) FROM benchmark) AS calls
FROM benchmark
""")
def generate_ledger(spark, sf):
    """Generation through a ledger, run twice: the second run makes no call."""
    ledger = scratch_path(spark, "ledger")
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    for _ in range(2):
        g = generate_once(q, callables.think_then_echo, ledger, "question", system_prompt="You answer from the context.",
                          group_rows=20)
    return g.select("item_id", "answer", F.lit(spark.read.parquet(ledger).count()).cast("long").alias("calls"))


@register("stream_repeats", f"""
SELECT b.item_id, c.copy, h.rank, h.hit_id AS chunk_id, h.score
FROM {TEXT_HITS_SQL} h JOIN benchmark b ON b.item_id = h.query_id, (VALUES (0), (1), (2)) c(copy)
""")
def stream_repeats(spark, sf):
    """Every question asked three times within the hour: the stream's state
    lets one pass, its hits answer all three."""
    base = scratch_path(spark, "stream-repeats")
    asked = (table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
             .withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
             .withColumn("asked_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("copy") * 600)))
    asked.repartition(4, "copy").write.parquet(f"{base}/in")
    pas = passages(spark, sf)
    build_vectors(pas, f"{base}/index", id_col="chunk_id")
    vecs = spark.read.parquet(f"{base}/index/vectors")

    def rank(batch):
        return retrieve(batch, pas, TEXT_K, TEXT_MIN, question_id="item_id", question_text="question",
                        passage_id="chunk_id", vectors=vecs).join(
            batch.select(F.col("item_id").alias("query_id"), "question"), "query_id")

    qs = file_stream(spark, f"{base}/in", asked.schema, max_files=1)
    answer_stream(first_questions(qs, "asked_at"), rank, f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    hits = answer_repeats(spark, spark.read.parquet(f"{base}/in").withColumn("query_id", F.struct("item_id", "copy")),
                          f"{base}/sink")
    return hits.select("query_id.item_id", "query_id.copy", F.col("rank").cast("long").alias("rank"),
                       F.col("hit_id").alias("chunk_id"), "score")


@register("stream_sections", f"""
SELECT doc_id, section_ord, title, section_id, chunk_id, chunk_index, text
FROM {S.char_chunks(S.section_rows(), "section_id", "text", SECTION_TOKENS, SECTION_OVERLAP,
                    extra="doc_id, section_ord, title")}
""")
def stream_sections(spark, sf):
    """Statute texts arriving as files, sectioned and chunked by the stream."""
    base = scratch_path(spark, "stream-sections")
    texts = conversation_statutes(spark, sf)
    texts.write.parquet(f"{base}/in")
    chunk_stream(file_stream(spark, f"{base}/in", texts.schema), f"{base}/sink", f"{base}/checkpoint",
                 SECTION_TOKENS, SECTION_OVERLAP, sections=True).awaitTermination()
    return (spark.read.parquet(f"{base}/sink").withColumn("section_ord", F.col("section_ord").cast("long"))
            .withColumn("chunk_index", F.col("chunk_index").cast("long")))
