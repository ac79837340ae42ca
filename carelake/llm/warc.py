"""WARC archives: writing pages as transactions, and assembling captures from the records read back.

A capture is a request, a response (or a revisit of one) and a metadata record; request and metadata name the
response in WARC-Concurrent-To. Archives are written by Spark's text writer, one record a line, with the record
separator as line end and gzip compression.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.shared import Scratch
from carelake.shipping import ship

FILE_BYTES = 16 << 20
DATE = "2024-01-31T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
#: The base32 alphabet.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its hexadecimal form: 40 bits make 8 of 32 letters."""
    letters = []
    for i in range(4):
        bits = F.conv(F.substring(F.sha1(data), 10 * i + 1, 10), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to, but not with, the two line ends that close it; headers without a value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block))
    return F.concat(F.concat_ws(_EOL, F.lit("WARC/1.1"), *lines, length), F.lit(_EOL + _EOL), block)


def _named(kind: str) -> Column:
    """A record id made of the page's id, its payload, its number among rows of both, and the kind of record."""
    return _urn(F.col("page_id").isNotNull(), F.col("home"), F.col("copy"), kind)


def _urn(known: Column, home: Column, copy: Column, kind: str) -> Column:
    """home is a page's id; a revisit has its own payload in common with the record that it refers to."""
    parts = (known.cast("string"), home.cast("string"), F.col("digest"), copy.cast("string"), F.lit(kind))
    name = F.md5(F.concat_ws(":", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write one transaction per row of pages (page_id, url, html) to gzipped archives below path.

    The payload is html in UTF-8, null being empty. Of rows with equal payloads of at least min_revisit_bytes the
    one with the largest page_id is a response and the others revisit it, without a payload of their own; smaller
    payloads are all responses. Equality is that of length, SHA-1 and SHA-256. A null page_id is never revisited
    and never revisits. Rows that repeat the response's page_id with its payload are responses too. Extra columns
    are ignored; an empty table writes no record.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = pages.select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest"))
    groups = slim.where("page_id is not null").groupBy("n", "digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("c"))
    groups = groups.where((F.col("c") > 1) & (F.col("n") >= min_revisit_bytes)).drop("c")
    revisits = slim.join(groups, ["n", "digest"]).where("page_id < owner").select("page_id", "digest", "owner").distinct()
    total = slim.agg(F.sum("n")).first()[0] or 0
    parts = 1 + total // file_bytes

    owners = revisits.groupBy(F.col("page_id").alias("home")).agg(
        F.map_from_entries(F.collect_list(F.struct("digest", "owner"))).alias("owners")
    )
    dealt = pages.withColumn("digest", F.sha2("html", 256))
    dealt = dealt.withColumn("home", F.coalesce("page_id", F.xxhash64("digest", "url"))).repartition(parts, "home")
    joined = dealt.join(owners.repartition(parts, "home"), "home", "left")
    # Rows of one page_id lie in one partition; equal payloads are numbered there, so record ids differ.
    number = F.expr("row_number() over (partition by home, digest order by url)")
    owner = F.when(F.col("page_id").isNotNull(), F.try_element_at("owners", F.col("digest")))
    made = joined.withColumn("owner", owner).withColumn("copy", number)
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    response, digest = _named("response"), F.concat(F.lit("sha1:"), base32_sha1(F.encode("html", "UTF-8")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
        F.octet_length("html"),
        F.lit(_EOL + _EOL),
    )
    revisit = F.col("owner").isNotNull()
    def headers(kind: Column, record_id: Column, content: str, more: list) -> list:
        return [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", uri),
            ("Content-Type", F.lit(content)),
            *more,
        ]

    about = [("WARC-Concurrent-To", response)]
    records = F.array(
        _record(
            headers(F.lit("request"), _named("request"), "application/http;msgtype=request", about),
            F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{_EOL}{_EOL}")),
        ),
        _record(
            headers(
                F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
                response,
                "application/http;msgtype=response",
                [
                    ("WARC-Payload-Digest", digest),
                    ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
                    ("WARC-Refers-To", F.when(revisit, _urn(F.lit(True), F.col("owner"), F.lit(1), "response"))),
                ],
            ),
            F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
        ),
        _record(
            headers(F.lit("metadata"), _named("metadata"), "application/warc-fields", about),
            F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_EOL)),
        ),
    )
    lines = made.select(F.explode(records).alias("value"))
    lines.write.mode("overwrite").option("lineSep", _EOL + _EOL).option("compression", "gzip").text(path)


def _records(stream: io.BufferedReader) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


class _Gunzip(io.RawIOBase):
    """A stream over the gzip members of a buffer, inflated piece by piece."""

    def __init__(self, data):
        self.data, self.at, self.engine, self.left = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left:
            if self.engine.eof:
                rest = self.engine.unused_data
                self.at -= len(rest)
                self.engine = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return 0
            piece = self.data[self.at : self.at + 65536]
            self.at += len(piece)
            self.left = self.engine.decompress(piece)
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


_READ = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _reader(payloads: bool):
    def fields(block: bytes) -> dict:
        head = block.split(b"\r\n\r\n", 1)[0]
        pairs = (x.partition(b":") for x in head.split(b"\r\n"))
        return {k.strip().lower().decode("latin1"): v.strip().decode("latin1") for k, _, v in pairs}

    def row(headers: dict, block: bytes) -> tuple:
        kind, digest, size, page, payload = headers.get("warc-type"), None, None, None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size = len(payload)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if told and told != digest:
                raise ValueError(f"record {headers.get('warc-record-id')} doesn't match its payload digest")
        elif kind == "revisit":
            size = int(fields(block).get("content-length") or 0)
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        elif kind == "metadata":
            page = int(found) if (found := fields(block).get("page_id")) else None
        ids = (headers.get(f"warc-{x}") for x in ("record-id", "concurrent-to", "refers-to", "target-uri"))
        return (kind, *ids, digest, size, page, payload if payloads else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for headers, block in _records(io.BufferedReader(_Gunzip(content.as_buffer()), 1 << 20)):
                    held.append(row(headers, block))
                    size += 500 + len(block) * payloads
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=_READ.names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=_READ.names)

    return read


def read_records(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the gzipped archives below path. A response's payload is checked against its digest.

    A response that differs from its digest stops the read with an error that names it; a record without a page_id or
    of an unknown type gives nulls. A folder without archives gives no rows.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_reader(payloads), _READ)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (id, uri, response, request, metadata).

    response holds type, digest, payload_bytes, refers_to and payload; request and metadata, joined through their
    concurrent-to ids, are null where there is none. Records of other kinds, and requests and metadata of no known
    response, are left out. Repeated records of one id give a row for each combination.
    """
    main = records.where("type in ('response', 'revisit')").select(
        "id", "uri", F.struct("type", "digest", "payload_bytes", "refers_to", "payload").alias("response")
    )
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("id", "uri").alias("request"))
    metadata = records.where("type = 'metadata'").select(
        F.col("concurrent_to").alias("id"), F.struct("id", "page_id").alias("metadata")
    )
    return main.join(request, "id", "left").join(metadata, "id", "left")


def page_captures(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and return one nested row per capture.

    A revisit's `original` is the page_id of the capture that it refers to, null for others. Null pages, ids, repeated
    rows and empty tables are as write_archives() has them.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(pages, f"{scratch.root}/archives", min_revisit_bytes)
    records = scratch.write(read_records(pages.sparkSession, f"{scratch.root}/archives"), "records")
    captures = scratch.write(assemble(records), "captures")
    originals = captures.where("response.type = 'response'").select(
        F.col("id").alias("original_id"), F.col("metadata.page_id").alias("original")
    )
    return captures.join(originals, F.col("response.refers_to") == F.col("original_id"), "left").drop("original_id")
