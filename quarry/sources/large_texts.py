"""Sections of text files of any size, read by many tasks.

Lines are read by byte ranges (a file of 2 GB is some sixteen splits), and the
lines of a split are packed into chunks of bounded bytes, which are stored
with their place.  A chunk's sections are found by itself; what a boundary can
cut is put together again:

* A header may go over several lines (white space after ``Section`` and after
  the number may hold line ends), so unfinished headers at the end of a chunk
  move to the beginning of the next one.  Chunks of less than two other lines
  of text move as a whole.
* The last section of a chunk is open: the next chunks begin with the rest of
  it.  Open sections, and only these, are shuffled by file and number.

Places and section numbers are counted over chunks (a few small rows for each
chunk), never over lines or texts.  The result equals splitting the whole file
read at once (:func:`quarry.operators.sections.split_sections`).
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.sections import (DEFAULT_PREFIX, FULL_ID, FULL_TITLE, marked_parts, section_of)
from quarry.functions.text import strip
from quarry.session import materialize

CHUNK_BYTES = 4 << 20
# A header that the end of a chunk may have cut: a number or a title is missing.
_UNFINISHED = re.compile(r"Section(\s+\d+[A-Z]?\.?)?\s*\Z")


def cut_header(text: str) -> tuple[str, str, bool]:
    """A chunk's text without and with only unfinished headers at its end, and
    whether the chunk stands by itself: two lines of text at least are left,
    more than a header that the chunk before could not finish may take."""
    at = len(text)
    while True:
        last = text.rfind("Section", 0, at)
        if last < 0 or (last and text[last - 1] != "\n") or not _UNFINISHED.match(text[last:at]):
            break
        at = max(0, last - 1)
        if last == 0:
            return "", text, False
    body = text[:at]
    if sum(1 for line in body.split("\n") if line.strip()) < 2:
        return "", text, False
    return body, text[at + 1:], True


FIELDS = "file string, block long, seq int, body string, tail string, whole boolean, n_bytes long, size long, cr boolean"


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``file, block, seq, body, tail, whole``: chunks of lines with their
    place; a line end counts as ``\\n`` in all its forms.  A line end at the
    end of a file is seen by its size."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n"), "value")

    def pack(batches):
        key, seq, held, n_bytes = None, 0, [], 0

        def made():
            cr = held[-1].endswith("\r")
            text = "\n".join(line[:-1] if line.endswith("\r") else line for line in held)
            row = [key[0], key[1], seq, *cut_header(text.replace("\r", "\n")), n_bytes, key[2], cr]
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

        for batch in batches:
            for *place, n, value in zip(*[c.to_pylist() for c in batch.columns]):
                if place != key:
                    if held:
                        yield made()
                    key, seq, held, n_bytes = place, 0, [], 0
                held.append(value)
                n_bytes += n + 1
                if n_bytes >= chunk_bytes:
                    yield made()
                    seq, held, n_bytes = seq + 1, [], 0
        if held:
            yield made()

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", ")])
    return materialize(lines.mapInArrow(pack, FIELDS))


def read_large_sections(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES,
                        prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """``path, section_ord, section_id, title, text`` of text files; one file
    is read by as many tasks as it has splits."""
    chunks = read_chunks(spark, path, chunk_bytes)
    place = Window.partitionBy("file").orderBy("block", "seq")
    units = materialize(chunks.select("file", "block", "seq", "whole").withColumn(
        "unit", F.sum(F.col("whole").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, 0))))
    ends = materialize(chunks.groupBy("file").agg(
        F.max(F.struct("block", "seq", "cr")).alias("last"),
        (F.pmod(F.max("size") - F.sum("n_bytes"), F.lit(3)) == 0).alias("closed")))  # a byte order mark has 3 bytes
    end = F.when((F.struct("block", "seq") == F.struct("last.block", "last.seq")) & (F.col("closed") | F.col("last.cr")),
                 F.lit("\n")).otherwise("")
    in_tail = ~F.col("whole") | (F.col("tail") != "")
    placed = (chunks.drop("whole").join(units, ["file", "block", "seq"]).join(ends, "file").withColumn("end", end)
              .withColumns({"tail": F.when(in_tail, F.concat("tail", "end")).otherwise(F.col("tail")),
                            "body": F.when(in_tail, F.col("body")).otherwise(F.concat("body", "end"))}))
    moved = (placed.filter("not whole or tail != ''")
             .groupBy("file", (F.col("unit") + 1).alias("unit"))
             .agg(F.array_sort(F.collect_list(F.struct("block", "seq", "tail"))).alias("parts"))
             .select("file", "unit", F.array_join("parts.tail", "\n").alias("before")))
    bodies = placed.filter("whole").select("file", "unit", "body")
    text = F.concat_ws("\n", F.col("before"), F.col("body"))
    whole = (bodies.join(moved, ["file", "unit"], "left").select("file", "unit", text.alias("text"))
             .unionByName(moved.join(bodies.select("file", "unit"), ["file", "unit"], "left_anti")
                          .select("file", "unit", F.col("before").alias("text"))))
    parts = materialize(whole.select("file", "unit", marked_parts("text").alias("parts")))
    sizes = parts.select("file", "unit", (F.size("parts") - 1).alias("n"))
    before = Window.partitionBy("file").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)),
                                 "total": F.sum("n").over(Window.partitionBy("file"))})
    pieces = (parts.join(materialize(offsets), ["file", "unit"])
              .select("file", "unit", "n", "base", "total", F.posexplode("parts").alias("pos", "part"))
              .withColumn("section_ord", (F.col("base") + F.col("pos") - 1).cast("int"))
              .filter((F.col("section_ord") >= 0) | (F.col("total") == 0)))
    closed = pieces.filter((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).select("file", "section_ord", "part", "total")
    opened = (pieces.filter((F.col("pos") == 0) | (F.col("pos") == F.col("n")))
              .groupBy("file", "section_ord", "total")
              .agg(F.array_sort(F.collect_list(F.struct("unit", "part"))).alias("parts"))
              .select("file", "section_ord", F.array_join("parts.part", "\n").alias("part"), "total"))
    both = closed.unionByName(opened)
    s = F.when(F.col("total") == 0, F.struct(F.lit(FULL_ID).alias("section_id"), F.lit(FULL_TITLE).alias("title"),
                                             strip(F.col("part")).alias("text"))).otherwise(
        section_of(F.col("part"), prefix))
    return both.select(F.col("file").alias("path"), F.greatest("section_ord", F.lit(0)).alias("section_ord"), s.alias("s")).select(
        "path", "section_ord", "s.section_id", "s.title", "s.text")
