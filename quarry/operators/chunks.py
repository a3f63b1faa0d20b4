"""Overlapping character chunks of section texts.

A text is cut once into pieces one step long; each window is a piece and the
beginning of the next ones, put together by zipping the pieces with
themselves, shifted.  Every character is touched a constant number of times,
only the windows are exploded (not the text), and all of it is native: a
narrow transformation without Python, linear in the length of a text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def check_window(chunk_tokens: int, overlap: int) -> None:
    if chunk_tokens <= 0 or overlap < 0:
        raise ValueError("chunk_tokens must be positive and overlap non-negative")
    if overlap >= chunk_tokens:
        raise ValueError("overlap must be smaller than chunk_tokens")


def n_windows(length: Column, width: int, step: int) -> Column:
    """Windows a text of ``length`` characters has: the first one that reaches
    the end is the last."""
    return F.when(length <= width, F.lit(1)).otherwise(
        F.lit(1) + F.floor((length - width + step - 1) / step).cast("int"))


def windows(text: Column, width: int, step: int) -> Column:
    """``array<string>`` of the windows of ``width`` characters every ``step``."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0)
    out = pieces
    for shift in range(1, -(-width // step)):
        later = F.slice(pieces, shift + 1, F.size(pieces))
        size = min(step, width - shift * step)
        out = F.zip_with(out, later, lambda a, b: F.concat(
            a, F.coalesce(F.substring(b, 1, size), F.lit(""))))
    return F.slice(out, 1, n_windows(F.length(text), width, step))


def chunk_id(section_id, idx) -> Column:
    """``<section>::chunk_0007``; indexes above 9999 keep all their digits."""
    sid = F.col(section_id) if isinstance(section_id, str) else section_id
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.format_string("%s::chunk_%04d", sid, i)


def char_chunks(df: DataFrame, chunk_tokens: int = 512, overlap: int = 64,
                text_col: str = "text", id_col: str = "section_id",
                keep=None) -> DataFrame:
    """Character windows of ``4*chunk_tokens`` with step ``4*(chunk_tokens-overlap)``.
    Output: ``keep..., chunk_id, chunk_index int, text``; empty texts give none."""
    check_window(chunk_tokens, overlap)
    width = chunk_tokens * CHARS_PER_TOKEN
    step = (chunk_tokens - overlap) * CHARS_PER_TOKEN
    keep = [c for c in (keep if keep is not None else [id_col]) if c != text_col]
    t = F.col(text_col)
    return (
        df.filter(F.length(t) > 0)
        .select(*keep, F.posexplode(windows(t, width, step)).alias("chunk_index", "_c"))
        .select(*keep, chunk_id(id_col, "chunk_index").alias("chunk_id"),
                F.col("chunk_index").cast("int").alias("chunk_index"), F.col("_c").alias(text_col))
    )


def chunk_counts(chunks: DataFrame, by: str = "section_id") -> DataFrame:
    """Chunks per section, ordered by id (a text sort)."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(by)
