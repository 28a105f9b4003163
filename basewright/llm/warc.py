"""WARC archives with revisit resolution.

Headers (record key, URI, payload digest, size) are grouped by payload digest, each digest's original response is
joined back to its revisits, and the archives are written anew: originals with their payload, revisits as
`revisit` records without one, all with fresh headers (date of writing, length, digest, what a revisit refers to by
number, URI and date). A digest that a third of all records share is one row for each task before the shuffle; see
`resolved` for the join. A file is one gzip stream, as Spark's text writer makes it, so archives are read from their
start, not by record; there is no warcinfo record.

Defined results. A null payload is empty. Payloads of fewer than `least_bytes` bytes are always responses. Of
equal payloads the record of smallest key is the response (a null key comes after all others; where all keys are
null, all are responses). Rows that repeat a key are records of their own; one that repeats the response's key and
payload is a response too. Line breaks in a target URI are written as %0D and %0A, a null URI as `urn:x-unknown:`. An
empty table gives no records. Payloads of any length are written whole, each held by one task. Other columns aren't
archived, whatever their names.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import fresh_path, written

LEAST_BYTES, FILE_BYTES = 100, 16 << 20
#: Fixed values of the format (ISO 28500).
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Originals (a digest, a number, a URI) are broadcast when counted to be so many at most, some 100 MB.
BROADCAST_ORIGINALS = 300_000
#: Bytes of records that a reading task hands on together.
READ_BYTES = 8 << 20

RECORD = "record_key long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def originals(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """payload_digest, refers_to, refers_uri of each payload that occurs more than once, as a written table.

    One row for each digest; the partial aggregates leave one row of a hot digest for each task.
    """
    first = F.min(F.struct(F.col("record_key").isNull().alias("none"), F.col("record_key").alias("key"), F.col("target_uri").alias("uri")))
    large = records.where(F.col("payload_bytes") >= least_bytes)
    found = large.groupBy("payload_digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return written(found.select("payload_digest", F.col("first.key").alias("refers_to"), F.col("first.uri").alias("refers_uri")), "originals")


def resolved(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """records (payload_digest, record_key, target_uri, payload_bytes and others) with `record_type`, `refers_to`, `refers_uri`.

    Few originals are broadcast, and payloads aren't shuffled at all. Beyond that the join has a plain exchange on
    either side (originals are a written table), so that Spark splits the records of a hot digest.
    """
    first = originals(records.select("record_key", "target_uri", "payload_digest", "payload_bytes"), least_bytes)
    first = F.broadcast(first) if first.count() <= BROADCAST_ORIGINALS else first
    met = records.join(first, "payload_digest", "left")
    again = F.coalesce((F.col("payload_bytes") >= least_bytes) & F.col("refers_to").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("refers_to")), F.lit(False))
    return met.select(*records.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("refers_to")).alias("refers_to"), F.when(again, F.col("refers_uri")).alias("refers_uri"))


def _uri(column: str) -> Column:
    """A URI as a header can hold it."""
    uri = F.coalesce(F.col(column), F.lit("urn:x-unknown:"))
    return F.regexp_replace(F.regexp_replace(uri, "\r", "%0D"), "\n", "%0A")


def record_text(payload: Column, date: str) -> Column:
    """A whole WARC record but for the two line ends that close it, from the columns of a resolved record."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    digest, size = F.col("payload_digest"), F.col("payload_bytes").cast("string")
    number = lambda c: F.concat(F.lit("<urn:x-record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    refers = [line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", number(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", _uri("refers_uri")), line("WARC-Refers-To-Date", F.lit(date))]
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", number(F.col("record_key"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri("target_uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(*refers)).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, "").otherwise(payload),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Write gzipped archives of about file_bytes each (before compression; one record at least) under path.

    `date` is that of all headers, the time of writing unless given.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    records = pages.select(F.col(key).cast("long").alias("record_key"), F.col(uri).alias("target_uri"), body.alias("_bw_payload"))
    records = records.withColumn("payload_digest", F.sha2(F.encode("_bw_payload", "UTF-8"), 256)).withColumn("payload_bytes", F.octet_length("_bw_payload").cast("long"))
    n, total = records.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = resolved(records, least_bytes).select(record_text(F.col("_bw_payload"), date).alias("value"))
    per_file = max(1, int(file_bytes * n // max(1, total or 1))) if n else 1
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive one by one: header fields by lower-case name, and the block."""
    while first := archive.readline():
        if first != f"{VERSION}\r\n".encode():
            raise ValueError(f"not the start of a record: {first[:40]!r}")
        fields = {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("an archive ends inside a header")
            name, _, value = line[:-2].decode("utf-8").partition(": ")
            fields[name.lower()] = value
        block = archive.read(int(fields["content-length"]))
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block


def _numbered(x: str | None) -> int | None:
    number = (x or "").removeprefix("<urn:x-record:").removesuffix(">")
    return int(number) if number not in ("", "none") else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under path; a task holds one compressed file and READ_BYTES of its records."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()

    def row(fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        kind = fields["warc-type"]
        return _numbered(fields["warc-record-id"]), kind, fields["warc-target-uri"], fields["warc-payload-digest"].removeprefix("sha256:"), size, _numbered(fields.get("warc-refers-to")), payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(gzip.open(io.BytesIO(data.as_py()))):
                    rows.append(row(fields, block))
                    held += len(block) + 256
                    if held >= READ_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def digests(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The contract's rows, as read back from the archives; a response's digest and size are those of its payload."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages.select("page_id", "url", "html"), path, least_bytes=least_bytes)
    back = read_archives(pages.sparkSession, path)
    own = F.col("payload").isNotNull()
    return back.select(
        F.col("record_key").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
