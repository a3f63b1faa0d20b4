"""Document sources: whole text files, paged sources, and source precedence."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, path: str, id_from_path: bool = True) -> DataFrame:
    """One record per file, the whole file as text (UTF-8); ``\\r\\n`` and
    lone ``\\r`` become ``\\n`` as in a universal-newline read.  A missing
    path raises.  Columns: ``path, text`` plus any partition columns."""
    df = spark.read.text(path, wholetext=True)
    return df.select(
        *[c for c in df.columns if c != "value"],
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )


# Marks of text files that hold several documents each, and how texts hold them.
_RECORD, _FIELD, _ESCAPE = "\x1e", "\x1f", "\x1b"
_HELD = ((_ESCAPE, _ESCAPE + "e"), (_RECORD, _ESCAPE + "r"), (_FIELD, _ESCAPE + "f"))
_NULL = _ESCAPE + "0"


def write_text_files(df: DataFrame, path: str, key: str = "doc_id", text_col: str = "text",
                     docs_a_file: int = 100) -> None:
    """Documents written into text files of at most ``docs_a_file`` documents,
    each with its key: a file of its own for every short text would cost more
    than the text.  Any text, null as well, comes back from
    :func:`split_documents`.  No shuffle."""
    def held(c):
        out = F.col(c).cast("string")
        for plain, mark in _HELD:
            out = F.replace(out, F.lit(plain), F.lit(mark))
        return F.coalesce(out, F.lit(_NULL))

    record = F.concat(F.lit(_RECORD), held(key), F.lit(_FIELD), held(text_col), F.lit(_FIELD))
    df.select(record).write.mode("overwrite").option("maxRecordsPerFile", docs_a_file).text(path)


def split_documents(files: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (``key`` as string, ``text_col``) of files that
    :func:`write_text_files` wrote and :func:`read_text_files` read."""
    def plain(c):
        out = c
        for given, mark in reversed(_HELD):
            out = F.replace(out, F.lit(mark), F.lit(given))
        return F.when(c != _NULL, out)

    records = files.select(F.explode(F.split("text", _RECORD)).alias("_r")).filter(F.col("_r") != "")
    return records.select(plain(F.split_part("_r", F.lit(_FIELD), F.lit(1))).alias(key),
                          plain(F.split_part("_r", F.lit(_FIELD), F.lit(2))).alias(text_col))


def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "text", block_pages: int = 4096) -> DataFrame:
    """Join the page texts of each document in page order with ``\\n``; a
    page without text counts as ''.

    Two levels, so that a document holding a large share of all pages is
    not concatenated by one task from single pages: pages are first joined
    per (document, block of ``block_pages`` consecutive page numbers), then
    the block texts per document in block order (joining blocks with the
    same separator gives the same text)."""
    sep = "\n"
    blk = F.floor(F.col(page_col) / F.lit(block_pages)).alias("_blk")
    lvl1 = (pages.select(doc_col, page_col, blk, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
            .groupBy(doc_col, "_blk")
            .agg(F.expr(f"listagg(_t, '{sep}') WITHIN GROUP (ORDER BY {page_col})").alias("_t")))
    return lvl1.groupBy(doc_col).agg(
        F.expr(f"listagg(_t, '{sep}') WITHIN GROUP (ORDER BY _blk)").alias(text_col))


def prefer_paged(paged: DataFrame, plain: DataFrame, key: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document: the paged source wins over the plain text source."""
    p = paged.select(key, F.lit("paged").alias("origin"), text_col)
    t = plain.join(paged.select(key), key, "left_anti").select(key, F.lit("text").alias("origin"), text_col)
    return p.unionByName(t)
