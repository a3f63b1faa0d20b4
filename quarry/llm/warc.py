"""WARC archives of pages, with revisit records for repeated payloads.

An archive is a folder of gzip files whose records are ``header CRLF CRLF
payload CRLF CRLF``; Spark's text writer puts the last four bytes as its line
separator.  Reading goes by ``Content-Length``, so a payload may hold any
bytes.  Revisits are resolved on headers alone: they are shuffled by payload
digest, the smallest record of a digest is the original, and payloads move
once, when the deduplicated archive with fresh headers is written.

Null payload: empty.  Null url: no target line; line breaks in a url are
percent-encoded.  Null ids: kept, never an original if another record of the
digest has an id.  Repeated rows: one of them is the response.  Payloads of
fewer than ``min_bytes`` bytes are always responses.  An empty table gives an
empty archive and an empty result.  A payload of any length is one record.

Records are written by size class (powers of 16), each in files of so many
records that a file has at most ``FILE_BYTES`` bytes, unless it is one record;
a file is unpacked whole by the task that reads it.
"""
from __future__ import annotations

import gzip
import hashlib
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

CRLF = "\r\n"
END = CRLF + CRLF
# Fixed value of the format: the profile of a revisit with an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("file string, position long, page_id string, url string, record_type string, "
          "digest string, refers_to string, payload_bytes long, date string")
FILE_BYTES = 64 << 20
SMALL = 1 << 12  # bytes of the records of the first size class, at most


def _line(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")),
                     F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))


def now() -> str:
    """The time as a record's date."""
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def record_text(page_id: Column, url: Column, payload: Column, digest: Column,
                refers_to: Column, date: Column) -> Column:
    """One record without its closing CRLF CRLF: a revisit (no payload) where
    ``refers_to`` is given, else a response."""
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(payload, F.lit("")))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(page_id)),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", _urn(refers_to)),
        _line("WARC-Profile", F.when(revisit, SAME_PAYLOAD)),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body)),
        F.lit(CRLF), body)


def write_archive(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write a one-column table of record texts as an archive, in one pass: a
    task's rows of a size class go to another file after every so many rows."""
    records = records.toDF("value")
    size = F.coalesce(F.octet_length("value"), F.lit(0))
    rank = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(size, F.lit(1)) / F.lit(float(SMALL))))).cast("int")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
    rows = F.greatest(F.lit(1), F.floor(F.lit(float(file_bytes)) / (F.lit(float(SMALL)) * F.pow(F.lit(16.0), F.col("rank")))))
    (records.withColumn("rank", rank).withColumn("part", F.floor(row / rows))
     .write.option("lineSep", END).option("compression", "gzip")
     .option("zlib.compress.level", "THREE").mode("errorifexists")
     .partitionBy("rank", "part").text(path))


def parse_records(data: bytes):
    """``(position, header fields, payload)`` of every record of one file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:body - 4].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        yield at, fields, data[body:body + n]
        at = body + n + 4


def _page(urn: str | None) -> str | None:
    return None if urn is None else urn[len("<urn:page:"):-1]


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of an archive; ``digest`` and ``payload_bytes`` are those
    of the payload as read for a response, as stated (and null) for a revisit."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows: list[list] = [[] for _ in range(9 + payload)]
                for at, fields, body in parse_records(content.as_py()):
                    whole = fields["WARC-Type"] == "response"
                    row = [name.as_py(), at, _page(fields.get("WARC-Record-ID")),
                           fields.get("WARC-Target-URI"), fields["WARC-Type"],
                           hashlib.sha256(body).hexdigest() if whole
                           else fields["WARC-Payload-Digest"].split(":")[1],
                           _page(fields.get("WARC-Refers-To")), len(body) if whole else None,
                           fields.get("WARC-Date")]
                    for column, value in zip(rows, row + [body.decode("utf-8")] * payload):
                        column.append(value)
                kinds = [pa.string(), pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, RECORD + ", payload string" * payload)


def resolve(headers: DataFrame, id_type: str, min_bytes: int = 100) -> DataFrame:
    """The revisits among response headers: ``file, position, refers_to``.
    Originals are one small row per digest that occurs again; a digest that
    fills a third of the table is a skewed probe side, which AQE splits."""
    key = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").cast(id_type).alias("id"),
                   "file", "position")
    heads = headers.filter(F.col("payload_bytes") >= min_bytes).select("digest", key.alias("key"))
    first = (heads.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and first.id is not null").select("digest", "first"))
    return (heads.join(first, "digest").filter("key != first")
            .select("key.file", "key.position", F.col("first.id").cast("string").alias("refers_to")))


def deduplicate(spark: SparkSession, raw: str, out: str, id_type: str = "bigint",
                min_bytes: int = 100) -> None:
    """Read the archive ``raw`` and write ``out``, where repeated payloads are
    revisit records."""
    revisits = resolve(read_archive(spark, raw), id_type, min_bytes)
    records = read_archive(spark, raw, payload=True).drop("refers_to")
    write_archive(records.join(revisits, ["file", "position"], "left").select(record_text(
        F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"),
        F.col("refers_to"), F.col("date")).alias("value")), out)


def archive_pages(spark: SparkSession, pages: DataFrame, out: str | None = None,
                  id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 100, date: str | None = None) -> DataFrame:
    """Write ``pages`` as an archive, deduplicate it into ``out`` and read that
    back: per page ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, url``, both payload columns of the full payload (a revisit
    takes them from the response it refers to).  Records are dated ``date``
    (default: now)."""
    id_type = pages.schema[id_col].dataType.simpleString()
    raw, out = scratch_path(spark, "warc-raw"), out or scratch_path(spark, "warc")
    body = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    write_archive(pages.select(record_text(
        F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), body, F.sha2(body.cast("binary"), 256),
        F.lit(None).cast("string"), F.lit(date or now())).alias("value")), raw)
    deduplicate(spark, raw, out, id_type, min_bytes)
    back = read_archive(spark, out).withColumn("page_id", F.col("page_id").cast(id_type)) \
        .withColumn("refers_to", F.col("refers_to").cast(id_type))
    whole = back.filter("record_type = 'response'")
    originals = (whole.filter(F.col("payload_bytes") >= min_bytes)
                 .groupBy(F.col("page_id").alias("refers_to"), "digest")
                 .agg(F.first("payload_bytes").alias("payload_bytes")))
    again = (back.filter("record_type = 'revisit'").drop("payload_bytes")
             .join(originals, ["refers_to", "digest"], "left"))
    return whole.unionByName(again).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        "refers_to", "url")
