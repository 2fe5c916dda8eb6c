r"""Operator 2: WARC archives: writing captures, reading records, assembling transactions.

write() turns each page into three records: its request, its response or revisit, and its
metadata. They name one another: request and metadata carry WARC-Concurrent-To with the id of
the response. Spark's text writer lays them down, gzipped, with the blank lines that end a
record as its line end, so archives go to whatever file system Spark reaches.

Equal payloads of at least MIN_REVISIT bytes are kept once: the one of the largest page_id is
the response, the others are revisits that name it in WARC-Refers-To and carry no payload.

read() takes archives back by Content-Length, record by record, one task a file; so a file holds
FILE_RECORDS records of payloads up to SMALL bytes, and fewer of larger ones (size classes of a
sixteenth each), which keeps its payloads to 64 MB or one capture. assemble() joins request, response and metadata through their concurrent-to ids to one
nested row a capture; revisits get payload size and digest from the response that they refer to. Which page a capture is of stands in its metadata record alone.

Defined cases: null html is an empty payload; null url is an empty target; rows that share
page_id and payload are captures of their own, and those of the largest page_id are all
responses; a request or metadata without its response is left out of assembled rows, a response
without them has nulls there and no page_id; an empty table gives an empty archive and result; other columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship

MIN_REVISIT = 1000
FILE_RECORDS = 3000
SMALL = 1 << 16
BATCH_BYTES = 1 << 23
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def _record(fields: list[tuple[str, Column]], body: Column) -> Column:
    """A record without the two line ends that close it; a field that is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(head, F.lit(CRLF * 2), body)


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with payload, its size and digest, the capture's id, and for revisits the response's page_id and id."""
    rows = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
        F.uuid().alias("salt"),
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    keep = rows.where(f"bytes >= {MIN_REVISIT}").groupBy("digest", "bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    keep = keep.where("n > 1").drop("n")
    rows = rows.join(keep, ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("page_id") != F.col("owner"), F.col("owner").isNotNull() & F.col("page_id").isNull())
    response_id = lambda page: _uuid(F.lit("response"), page.cast("string"), F.col("digest"))
    rows = rows.withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
    # an owner's record id follows from its page and digest; others' are their own
    named = F.col("page_id") == F.col("owner")
    rows = rows.withColumn("id", F.when(named, response_id(F.col("page_id"))).otherwise(_uuid(F.lit("capture"), F.col("salt"))))
    return rows.withColumn("refers", F.when(F.col("kind") == "revisit", response_id(F.col("owner"))))


def size_classes(largest: int) -> list[tuple[int, int, int]]:
    """(bytes above, bytes up to, records a file) of each class of payload sizes, until the largest."""
    classes, lo, hi, n = [], -1, SMALL, FILE_RECORDS
    while lo < max(largest, 0):
        classes.append((lo, hi, n))
        lo, hi, n = hi, hi * 16, max(3, n // 16)
    return classes


def write(pages: DataFrame, path: str) -> None:
    """Write the archives of pages(page_id, url, html) under path, which must not exist.

    Each size class is written by itself: equal payloads are of one class, so the choice of responses isn't touched.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    largest = pages.agg(F.max(size)).first()[0] or 0
    for lo, hi, n in size_classes(largest):
        of_class = pages.where((size > lo) & (size <= hi)) if largest > SMALL else pages
        writer = records(of_class).write.mode("error" if lo < 0 else "append")
        writer.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", n).text(path)


def records(pages: DataFrame) -> DataFrame:
    """The three records of each page as rows of a column value."""
    rows = plan_records(pages)
    page = F.col("page_id").cast("string")
    common = lambda kind, id_: [
        ("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")),
    ]
    partner = ("WARC-Concurrent-To", F.col("id"))
    # ids of requests and metadata hang on the capture's own salt
    request = _record(
        [*common(F.lit("request"), _uuid(F.lit("request"), F.col("salt"))), partner, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}User-Agent: tidemark{CRLF * 2}")),
    )
    own = F.col("kind") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    response = _record(
        [
            *common(F.col("kind"), F.col("id")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.col("refers")),
            ("WARC-Profile", F.when(~own, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(own, F.col("payload")).otherwise(F.lit(""))),
    )
    metadata = _record(
        [*common(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("salt"))), partner, ("X-Page-ID", page), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("fetchTimeMs: 0"), F.lit(CRLF), F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF)),
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, held one at a time."""
    while line := archive.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = archive.read(size)
        if len(block) < size:
            raise ValueError(f"archive ends inside record {fields.get('warc-record-id')}")
        yield fields, block


_FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "concurrent_to": "warc-concurrent-to", "refers_to": "warc-refers-to", "url": "warc-target-uri", "date": "warc-date", "digest": "warc-payload-digest"}


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under path: header fields, page_id, payload size and digest as found, and the payload."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    types = [pa.string()] * len(_FIELDS) + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [*_FIELDS, "page_id", "found_bytes", "found_sha1", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                archive = io.BytesIO(data)
                rows, held = [], 0
                for fields, block in parse(gzip.GzipFile(fileobj=archive) if archive.getbuffer()[:2] == b"\x1f\x8b" else archive):
                    row = [fields.get(name) for name in _FIELDS.values()]
                    page = fields.get("x-page-id")
                    payload = block.partition(b"\r\n\r\n")[2] if row[0] in ("response", "revisit") else block
                    rows.append((*row, int(page) if page else None, len(payload), hashlib.sha1(payload).hexdigest(), payload if with_payload else None))
                    held += len(payload) if with_payload else 0
                    if held >= BATCH_BYTES or len(rows) >= FILE_RECORDS:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = ", ".join(f"{x} string" for x in _FIELDS) + ", page_id long, found_bytes long, found_sha1 string, payload binary"
    return files.mapInArrow(task, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: page_id, record_type, response, request, metadata, and the response it refers to."""
    main = records.where("type in ('response', 'revisit')")
    side = records.where("type in ('request', 'metadata')").select("concurrent_to", "type", "page_id", F.struct("record_id", "url", "date", "found_bytes", "payload").alias("r"))
    side = side.groupBy("concurrent_to").agg(
        F.min(F.when(F.col("type") == "request", F.col("r"))).alias("request"), F.min(F.when(F.col("type") == "metadata", F.col("r"))).alias("metadata"),
        F.min(F.when(F.col("type") == "metadata", F.col("page_id"))).alias("page_id"),
    )
    capture = main.drop("page_id").join(side.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
    owners = capture.where("type = 'response' and digest is not null").select(
        F.col("record_id").alias("owner_id"), F.struct(F.col("page_id"), F.col("found_bytes").alias("bytes"), F.col("found_sha1").alias("sha1")).alias("owner")
    )
    # written, so that the join below reads both sides alike and can split a response that many refer to
    owners = materialize(owners.dropDuplicates(["owner_id"]), "owners")
    capture = capture.join(owners, F.col("refers_to") == F.col("owner_id"), "left")
    return capture.select(
        "page_id",
        F.col("type").alias("record_type"),
        F.struct("record_id", "url", "date", "digest", "found_bytes", "found_sha1", "payload").alias("response"),
        "request",
        "metadata",
        "owner",
    )


def digest(captures: DataFrame) -> DataFrame:
    """One row a page: size and digest of the full payload, record type, and the response's page for revisits."""
    own = F.col("record_type") == "response"
    return captures.select(
        "page_id",
        F.when(own, F.col("response.found_bytes")).otherwise(F.col("owner.bytes")).alias("payload_bytes"),
        F.when(own, F.col("response.found_sha1")).otherwise(F.col("owner.sha1")).alias("payload_digest"),
        "record_type",
        F.when(~own, F.col("owner.page_id")).alias("refers_to"),
    )
