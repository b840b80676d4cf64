"""Web archives: ARC files of versions 1 and 2, converted to WARC.

An ARC file starts with a version block, whose first line names the version,
whose second line gives its number and whose third line names the fields of
every record line. Record lines are read by the fields of their own file, and
the payload by its declared length, never by looking for separators in it. From
these the converter makes the WARC record: an id (a UUID from the record's own
line and digest, so a rerun makes the same), an ISO date from the 14 digits, a
type, and the payload's SHA-1 in base32. Of equal payloads the one with the
smallest page id is the response and the others are revisits without payload.

Files are written by Spark's text writer, whose line separator is what stands
between records, and read back by its binary reader, so archives live in any
store that Spark knows. A file holds at most ``RECORDS`` records.

A null html is an empty payload; a null url is ``about:blank``; a null page id
sorts last and reads back as null; rows that repeat both page id and payload
are of the same type; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songfield.llm.common import shared_folder

RECORDS = 1024
STAMP = "20240101000000"
#: The record lines of the two versions of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_ROW = "page_id bigint, url string, ip string, date string, mime string, status int, record_id string, digest string, length bigint, payload binary"
WARC_ROW = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, date string"
PAGE_MARK = "#arc-page="


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str | None) -> str:
    """A url as one field of a record line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def version_block(version: int) -> str:
    body = f"{version} 0 songfield\n{ARC_FIELDS[version]}\n"
    first = f"filedesc://songfield.arc 0.0.0.0 {STAMP} text/plain"
    return (f"{first} {len(body)}\n" if version == 1 else f"{first} 200 - - 0 songfield.arc {len(body)}\n") + body


def write_arc(pages: DataFrame, path: str, version: int = 2) -> None:
    """Writes (page_id, url, html) rows as ARC files."""
    block = version_block(version)

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for page, url, html in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns)):
                    if n % RECORDS == 0:
                        out.append(block)
                        n += 1
                    n += 1
                    size = len((html or "").encode())
                    head = f"{_escaped(url)}{PAGE_MARK}{'' if page is None else page} 0.0.0.0 {STAMP} text/html"
                    head += f" {size}\n" if version == 1 else f" 200 - - 0 songfield.arc {size}\n"
                    out.append(head + (html or ""))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    (
        rows.mapInArrow(lines, "value string")
        .write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS)
        .text(path)
    )


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of one ARC file. A line that doesn't fit the file's fields,
    or a length beyond the file, is an error: nothing is skipped in silence."""
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogateescape")
        size = int(line.rpartition(" ")[2])
        payload = data[end + 1 : end + 1 + size]
        if len(payload) != size:
            raise ValueError(f"record at {at}: {size} bytes declared, {len(payload)} left")
        at = end + 1 + size
        if line.startswith("filedesc:"):
            version_line, names = payload.decode().split("\n")[:2]
            fields = names.split(" ")
            if int(version_line.split(" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"unknown version: {version_line}")
            continue
        values = line.split(" ")
        if fields is None or len(values) != len(fields):
            raise ValueError(f"record line of {len(values)} fields: {line[:200]}")
        yield dict(zip(fields, values)) | {"payload": payload, "line": line}


def arc_record(raw: dict) -> dict:
    """What a WARC record needs, made from an ARC record's own fields."""
    url, _, page = raw["URL"].rpartition(PAGE_MARK) if PAGE_MARK in raw["URL"] else (raw["URL"], "", "")
    d, digest = raw["Archive-date"], base32_sha1(raw["payload"])
    return {
        "page_id": int(page) if page else None,
        "url": url,
        "ip": raw["IP-address"],
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "mime": raw["Content-type"],
        "status": int(raw.get("Result-code", "200")),
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, raw['line'] + digest)}>",
        "digest": digest,
        "length": len(raw["payload"]),
        "payload": raw["payload"],
    }


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _plain(path: str, content: bytes) -> bytes:
    return gzip.decompress(content) if path.endswith(".gz") else content


def _parsed(spark: SparkSession, path: str, records, schema: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[c.split(" ")[1]]) for n, c in zip(names, schema.split(", "))])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                out = []
                for record in records(_plain(file.as_py(), content.as_py())):
                    out.append({n: record[n] for n in names})
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, arrow)

    return _files(spark, path).mapInArrow(rows, schema)


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of ARC files; without ``payload`` only what describes them."""
    schema = ARC_ROW if payload else ARC_ROW.removesuffix(", payload binary")
    return _parsed(spark, path, lambda data: map(arc_record, parse_arc(data)), schema)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """Converts ARC files. Payloads of ``least`` bytes or more are stored once."""
    firsts = (
        read_arc(spark, arc, payload=False)
        .filter(F.col("length") >= least)
        .groupBy("digest", "length")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "length", "first")
    )
    both = read_arc(spark, arc).join(firsts, ["digest", "length"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    http = F.concat(F.lit("HTTP/1.1 "), F.col("status"), F.lit(" OK\r\nContent-Type: "), "mime", F.lit("\r\nContent-Length: "), "length", F.lit("\r\n\r\n"))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("length"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("length").cast("string")),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                line("WARC-Refers-To", F.col("first.record_id")),
                line("X-Refers-To-Page-Id", F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        http,
    )
    # A cast from binary keeps the bytes as they are, whatever their encoding.
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    (
        both.select(F.concat(head, body).alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS)
        .text(warc)
    )


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of one WARC file, read by their declared lengths; a stored
    payload that doesn't fit its digest is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}: {first[:100]}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end after {size} bytes")
        at = end + 8 + size
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
        length = len(payload) if kind == "response" else int(head["x-payload-length"])
        if kind == "response" and base32_sha1(payload) != digest:
            raise ValueError(f"payload of {head['warc-record-id']} has another digest")
        page, refers = head["x-page-id"], head.get("x-refers-to-page-id", "")
        yield {
            "page_id": int(page) if page else None,
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": int(refers) if refers else None,
            "target_uri": head["warc-target-uri"],
            "date": head["warc-date"],
            "payload": payload,
        }


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    return _parsed(spark, path, parse_warc, WARC_ROW + ", payload binary" * payload)


def archived(pages: DataFrame, version: int = 2) -> DataFrame:
    """Pages by way of ARC and WARC files in the shared folder, read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/songfield/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc", version)
    arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")
