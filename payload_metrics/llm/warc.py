"""WARC archives whose repeated payloads are revisit records.

Captures are resolved by their headers alone: ids, lengths and digests are shuffled by payload
digest, the first capture of a payload stays a response, and the others are joined to it as
revisits. Payloads never move for that; they meet the resolution in one join on the row. The
deduplicated archives get fresh headers: new record ids, the date of writing, and for revisits
the profile and the ids, target and date of the response they refer to.

An archive is written by the text writer, one record per line with the record separator as the
line separator, so writing commits and retries like any other Spark output. It is read back as a
whole file, decompressed as a stream and cut by the lengths in its headers, so payloads may
contain any bytes. A file is bounded by a number of records that follows from the mean length.

Defined cases: a null payload is empty; payloads below ``min_bytes`` are never revisits; of equal
payloads the smallest page id is the response, of equal ids the first row; null ids come last and
have no id in the archive; a null address becomes an address that names the id; line breaks and
blanks in addresses are escaped; an empty table writes an archive without a record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder
from payload_metrics.sources.tables import stage

# Fixed values of the archive format.
VERSION = "WARC/1.1"
BREAK = "\r\n"
RECORD_END = BREAK * 2
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGEST_PREFIX = "sha256:"

MIN_BYTES = 100
FILE_BYTES = 16 << 20
RECORDS = (
    "record_id string, type string, page_id long, uri string, date string, refers_to_record string, "
    "digest string, payload_bytes long, payload_digest string, payload binary"
)


def captures(pages: DataFrame) -> DataFrame:
    """A written table of captures from ``pages (page_id, url, html)``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    address = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("urn:page:"), name))
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.regexp_replace(address, r"[\x00-\x20\x7f]", "%20").alias("uri"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(rows, "captures", new_folder(pages.sparkSession, "captures"))


def from_archive(records: DataFrame) -> DataFrame:
    """Captures of archived records, to write them anew: a revisit has the payload of its response."""
    responses = records.where("type = 'response'").select(F.col("record_id").alias("of"), F.col("payload").alias("own"))
    joined = records.join(responses, F.coalesce("refers_to_record", "record_id") == F.col("of"), "left")
    rows = joined.select(
        "page_id",
        "uri",
        F.coalesce("own", "payload").alias("payload"),
        "digest",
        F.octet_length(F.coalesce("own", "payload")).cast("long").alias("payload_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(rows, "captures", new_folder(records.sparkSession, "captures"))


def revisits(captured: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(row, original)`` for each capture whose payload an earlier one has; headers only."""
    headers = captured.where(F.col("payload_bytes") >= min_bytes).select("digest", "page_id", "row", "uri")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "uri")
    firsts = headers.groupBy("digest").agg(F.min(order).alias("original"), F.count("*").alias("n"))
    # Written, so that the join can split a payload that most captures share.
    spark = captured.sparkSession
    firsts = stage(firsts.where("n > 1").drop("n"), "originals", new_folder(spark, "originals"))
    joined = headers.join(firsts, "digest").where(F.col("row") != F.col("original.row"))
    return joined.select("row", "original")


def _record_id(page_id: Column, row: Column, salt: str) -> Column:
    text = F.md5(F.concat_ws("/", F.lit(salt), F.coalesce(page_id.cast("string"), F.lit("none")), row.cast("string")))
    parts = [F.substring(text, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _head(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)) for name, value in fields]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def write_archives(captured: DataFrame, path: str, date: str, min_bytes: int = MIN_BYTES) -> None:
    """Deduplicated archives of ``captured`` below ``path``, gzip compressed."""
    joined = captured.join(revisits(captured, min_bytes), "row", "left")
    first = F.col("original.row").isNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(BREAK * 2),
    )
    length = F.octet_length(http) + F.when(first, F.octet_length("payload")).otherwise(0)
    refers = F.when(~first, _record_id(F.col("original.page_id"), F.col("original.row"), path))
    head = _head(
        ("WARC-Type", F.when(first, F.lit("response")).otherwise(F.lit("revisit"))),
        ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"), path)),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit(DIGEST_PREFIX), "digest")),
        ("WARC-Profile", F.when(~first, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", refers),
        ("WARC-Refers-To-Target-URI", F.when(~first, F.col("original.uri"))),
        ("WARC-Refers-To-Date", F.when(~first, F.lit(date))),
        ("Page-ID", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", length.cast("string")),
    )
    body = F.when(first, F.col("payload").cast("string")).otherwise(F.lit(""))
    record = F.concat(F.lit(VERSION + BREAK), head, F.lit(BREAK), http, body)
    mean = captured.agg(F.avg("payload_bytes")).first()[0] or 0
    per_file = max(1, int(FILE_BYTES / (mean + 600)))
    writer = joined.select(record.alias("value")).write.option("lineSep", RECORD_END)
    writer.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record is cut short")
        yield fields, block


def _opened(content: bytes) -> io.BufferedIOBase:
    """The archive as a stream; gzip members, one or many, are decompressed piece by piece."""
    stream = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) if content[:2] == b"\x1f\x8b" else stream


def _parser(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(name, pa.int64() if kind == "long" else pa.binary() if kind == "binary" else pa.string()) for name, kind in (f.split() for f in RECORDS.split(", "))]
        )
        for batch in batches:
            for content in batch["content"]:
                data = content.as_py()
                stream = _opened(data)
                rows, size = [], 0
                for fields, block in parse(stream):
                    rows.append(_row(fields, block, with_payload))
                    size += len(block)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    payload = block.partition(b"\r\n\r\n")[2] if fields["content-type"].startswith("application/http") else block
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_id": fields["warc-record-id"],
        "type": fields["warc-type"],
        "page_id": int(fields["page-id"]) if "page-id" in fields else None,
        "uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to_record": fields.get("warc-refers-to"),
        "digest": fields.get("warc-payload-digest", "").removeprefix(DIGEST_PREFIX),
        "payload_bytes": None if revisit else len(payload),
        "payload_digest": None if revisit else hashlib.sha256(payload).hexdigest(),
        "payload": payload if with_payload and not revisit else None,
    }


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records below ``path``; payload length and digest are taken from the payload itself."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parser(with_payload), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Every record with the full payload's length and digest, revisits through their response.

    ``records`` is a written table without payloads. A revisit whose response is missing, or has
    another digest than the revisit names, keeps null.
    """
    responses = records.where("type = 'response'").select(
        F.col("record_id").alias("of"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest"),
    )
    is_revisit = F.col("type") == "revisit"
    met = (F.col("refers_to_record") == F.col("of")) & (F.col("digest") == F.col("full_digest"))
    found = records.where(is_revisit).join(responses, met, "left")
    own = records.where(~is_revisit).select(
        "*", F.lit(None).cast("long").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")
    )
    columns = ["page_id", "type", "refers_to", "full_bytes", "full_digest"]
    return own.select(*columns).unionByName(found.select(*columns))
