"""Split texts into sections on ``Section N. Title`` header lines.

The split is one native expression per row: every header match is replaced
by private-use markers, the text is split on them, and the parts are read
off with ``split_part``.  Documents are independent, so this is a narrow
transformation (no shuffle) and also runs on a stream unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col_of, rstrip_dots, strip

# The header pattern, with Java flags that give Python's
# re.MULTILINE semantics on str ((?d): only \n ends a line; (?U): Unicode
# classes for \s and \d), and the record used when no header exists.
HEADER = r"(?mdU)^Section\s+(\d+[A-Z]?)\.\s+(.*)$"
DEFAULT_PREFIX = "BNS_"
FULL_ID = "BNS_FULL"
FULL_TITLE = "BNS Full Text"

_M0, _M1, _M2 = "\ue000", "\ue001", "\ue002"


def marked_parts(text):
    """A text cut at its headers: what lies before the first one, then one
    part per section (:func:`section_of` reads it)."""
    t = F.regexp_replace(F.coalesce(col_of(text), F.lit("")), "[\ue000-\ue002]", "")
    return F.split(F.regexp_replace(t, HEADER, _M0 + "$1" + _M1 + "$2" + _M2), _M0)


def section_of(part, prefix: str = DEFAULT_PREFIX):
    """``struct<section_id, title, text>`` of one part with a header."""
    num = F.substring_index(part, _M1, 1)
    title = rstrip_dots(strip(F.substring_index(F.substring_index(part, _M2, 1), _M1, -1)))
    body = strip(F.substring_index(part, _M2, -1))
    full = F.concat(F.lit("Section "), num, F.lit(". "), title, F.lit(".\n\n"), body)
    return F.struct(F.concat(F.lit(prefix), num).alias("section_id"), title.alias("title"), full.alias("text"))


def section_structs(text, prefix: str = DEFAULT_PREFIX):
    """``array<struct<section_id, title, text>>`` for one text column."""
    parts = marked_parts(text)
    fallback = F.array(F.struct(F.lit(FULL_ID).alias("section_id"),
                                F.lit(FULL_TITLE).alias("title"),
                                strip(parts[0]).alias("text")))
    return F.when(F.size(parts) <= 1, fallback).otherwise(
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda p: section_of(p, prefix)))


def split_sections(df: DataFrame, text_col: str = "text", keys=("doc_id",),
                   prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """One row per section: ``keys..., section_ord int, section_id, title, text``.
    Text before the first header is dropped; a text without any header gives
    one full-text record; repeated ids stay."""
    keys = list(keys)
    return (
        df.select(*keys, F.posexplode(section_structs(text_col, prefix)).alias("section_ord", "s"))
        .select(*keys, "section_ord", "s.section_id", "s.title", "s.text")
    )
