"""Corpus preparation: pages, source precedence, sections and chunks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunks import char_chunks, chunk_counts
from quarry.operators.sections import split_sections
from quarry.plans import sql as S
from quarry.plans.registry import register, table
from quarry.sources.documents import assemble_pages, prefer_paged

# Fixed parameters of the checks.
DOC_TOKENS, DOC_OVERLAP = 128, 16
SECTION_TOKENS, SECTION_OVERLAP = 32, 8


def conversation_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as paged documents: one page per turn."""
    c = table(spark, sf, "conversations")
    return assemble_pages(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))


def conversation_statutes(spark: SparkSession, sf: str) -> DataFrame:
    """One statute-like text per conversation: ``Section {turn}. {role}.``
    header lines, each followed by the turn's text."""
    c = table(spark, sf, "conversations")
    page = F.concat(F.lit("Section "), F.col("turn").cast("string"), F.lit(". "), F.col("role"),
                    F.lit(".\n"), F.coalesce("text", F.lit("")))
    return assemble_pages(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"),
                                   page.alias("text")))


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("section_id"), "text")
    return char_chunks(d, DOC_TOKENS, DOC_OVERLAP, keep=["doc_id", "section_id"])


DOC_CHUNKS_SQL = S.char_chunks("documents", "CAST(doc_id AS VARCHAR)", "text", DOC_TOKENS, DOC_OVERLAP,
                               extra="doc_id")


@register("page_assembly", f"""
SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def page_assembly(spark, sf):
    return conversation_pages(spark, sf)


@register("source_precedence", f"""
WITH paged AS (SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text
               FROM conversations GROUP BY conv_id)
SELECT doc_id, 'paged' AS origin, text FROM paged
UNION ALL
SELECT d.doc_id, 'text' AS origin, d.text FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM paged p WHERE p.doc_id = d.doc_id)
""")
def source_precedence(spark, sf):
    plain = table(spark, sf, "documents").select("doc_id", "text")
    return prefer_paged(conversation_pages(spark, sf), plain)


@register("section_split", f"SELECT * FROM {S.section_rows()}")
def section_split(spark, sf):
    return split_sections(conversation_statutes(spark, sf)).withColumn(
        "section_ord", F.col("section_ord").cast("long"))


@register("section_fallback", f"""
SELECT doc_id, CAST(0 AS BIGINT) AS section_ord, 'BNS_FULL' AS section_id, 'BNS Full Text' AS title,
       {S.strip("coalesce(text, '')")} AS text
FROM documents
""")
def section_fallback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return split_sections(d).withColumn("section_ord", F.col("section_ord").cast("long"))


@register("char_chunks", f"SELECT doc_id, section_id, chunk_id, chunk_index, text FROM {DOC_CHUNKS_SQL}")
def char_chunks_check(spark, sf):
    return document_chunks(spark, sf).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("chunk_counts", f"""
SELECT section_id, count(*) AS n_chunks FROM {DOC_CHUNKS_SQL} GROUP BY section_id ORDER BY section_id
""")
def chunk_counts_check(spark, sf):
    return chunk_counts(document_chunks(spark, sf), "section_id")


@register("section_chunks", f"""
SELECT doc_id, section_ord, title, section_id, chunk_id, chunk_index, text
FROM {S.char_chunks(S.section_rows(), "section_id", "text", SECTION_TOKENS, SECTION_OVERLAP,
                    extra="doc_id, section_ord, title")}
""")
def section_chunks(spark, sf):
    sections = split_sections(conversation_statutes(spark, sf))
    return (char_chunks(sections, SECTION_TOKENS, SECTION_OVERLAP,
                        keep=["doc_id", "section_ord", "title", "section_id"])
            .withColumn("section_ord", F.col("section_ord").cast("long"))
            .withColumn("chunk_index", F.col("chunk_index").cast("long")))
