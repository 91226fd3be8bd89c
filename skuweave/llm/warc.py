"""WARC archives: writing, reading, and resolving revisits.

A record is one row of a text file whose line separator is the blank lines that end a WARC record, so Spark's own writer
makes the archives, in any store and with its commit protocol (gzip over each file; a file holds so few records that together they
stay under FILE_BYTES, or one). Payloads are bytes and are never decoded. Reading streams each file and parses it by the
records' Content-Length, and archives of others are read too: any version, gzip by record or by file; digest and length of a
payload are computed where the header lacks them. A file is read by one task, which holds the compressed file and one
record (Spark's reader takes files of up to 2 GB).

rewrite() keeps what it reads: the HTTP header block of each response and revisit, payload bytes of any kind, and records of other
types (warcinfo, request, metadata, and so on) with their headers as they are. Digest and length are those of the bytes written.

Revisits: of all records only headers are shuffled, by payload digest and length. Of records with equal payloads, that with
the largest id among those with a payload is the response; the others become revisits that name it. Records are written once,
each with a number (row), by which payloads then meet their decision. A digest with many records is joined by broadcast (at
most 2,048 such digests exist).

Defined cases: a null payload counts as empty; a null id is less than any other and is read back as null; of equal ids with
equal payloads one is the response; payloads shorter than min_bytes are never revisits; a payload of any length is written
whole; a revisit whose response is in no archive stays a revisit of what it named; records that share an id are records of
their own; a record whose payload differs from its digest or length is read with intact False, and rewritten under its true digest; line
breaks in URLs are dropped; an empty table gives empty archives; further columns of pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, new_path, written

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("source_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("refers_to_record", T.StringType()),
    T.StructField("intact", T.BooleanType()), T.StructField("content_type", T.StringType()), T.StructField("http", T.BinaryType()),
    T.StructField("header", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])
#: Records of these types are resolved; others are passed on with their header.
RESOLVED = ("response", "revisit")
WEB = "application/http; msgtype=response"
FILE_BYTES, SMALL = 1 << 30, 100_000  # bytes of records in a file; records above SMALL bytes are counted on their own


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits are 10 hexadecimal digits and 8 of base 32."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records_of(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each page, in SCHEMA. Record ids come from the row's place; write the result before it is used
    twice."""
    payload = F.coalesce(F.col(html), F.lit(""))
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.monotonically_increasing_id()), 256)
    hexa = F.substring(key, 1, 32)
    record = F.concat(F.lit("urn:uuid:"), F.regexp_replace(hexa, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return pages.select(
        record.alias("record_id"), F.lit("response").alias("record_type"), F.col(id).cast("long").alias("source_id"),
        F.regexp_replace(F.col(url), "[\r\n]+", "").alias("url"), F.lit(date).alias("date"), base32_sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_record"), F.lit(True).alias("intact"), F.lit(WEB).alias("content_type"), F.lit(HTTP.encode()).alias("http"),
        F.lit(None).cast("binary").alias("header"), payload.cast("binary").alias("payload"),
    )


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """For each header: row, record_type, refers_to, refers_to_record. headers: SCHEMA without payload, and row."""
    heads = headers.select("row", "record_id", "record_type", "source_id", "refers_to", "refers_to_record", F.struct("payload_digest", "payload_bytes").alias("content"))
    full = F.when(F.col("record_type") != "revisit", F.struct("source_id", "record_id", "row"))
    groups = heads.groupBy("content").agg(F.max(full).alias("first"), F.count("*").alias("n"))
    groups = written(groups, "payloads")
    found = lookup(heads, groups, "content", "n")
    again = (F.col("content.payload_bytes") >= min_bytes) & (F.col("first.row") != F.col("row")) | (F.col("record_type") == "revisit")
    again = F.coalesce(again, F.lit(True))
    named = again & F.col("first").isNotNull()
    return found.select(
        "row", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(named, F.col("first.source_id")).when(again, F.col("refers_to")).alias("refers_to"),
        F.when(named, F.col("first.record_id")).when(again, F.col("refers_to_record")).alias("refers_to_record"),
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes records (SCHEMA; the payload of a revisit is not read) as archives under path. records are read twice or three times,
    so they should be written already."""
    again, other = F.col("record_type") == "revisit", ~F.col("record_type").isin(*RESOLVED)
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  bytes as they are
    block = F.when(other, raw("payload")).when(again, raw("http")).otherwise(F.concat(raw("http"), raw("payload")))
    optional = lambda name, value: F.coalesce(_line(name, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), optional("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        optional("WARC-Target-URI", F.col("url")), optional("WARC-Date", F.col("date")),
        optional("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), optional("X-Source-Id", F.col("source_id").cast("string")),
        optional("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(_line("WARC-Profile", F.lit(PROFILE)), optional("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_record", F.lit(">"))), optional("X-Refers-To-Source-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        _line("Content-Type", F.coalesce("content_type", F.lit(WEB))), _line("Content-Length", F.octet_length(block).cast("string")),
    )
    head = F.when(other, F.concat(raw("header"), F.lit("\r\n"))).otherwise(head)
    size = F.coalesce(F.octet_length("payload"), F.lit(0)) + F.coalesce(F.octet_length("http"), F.lit(0)) + F.coalesce(F.octet_length("header"), F.lit(0)) + 1000
    most = records.agg(F.max(size)).first()[0] or 0
    rows = records.withColumn("_size", size)
    parts = [(rows, most)] if most <= SMALL else [(rows.filter(F.col("_size") <= SMALL), SMALL), (rows.filter(F.col("_size") > SMALL), most)]
    for i, (part, largest) in enumerate(parts):
        options = {"lineSep": "\r\n\r\n", "compression": "gzip", "maxRecordsPerFile": max(1, file_bytes // max(1, largest)), "zlib.compress.level": "BEST_SPEED"}
        part.select(F.concat(head, F.lit("\r\n"), block).alias("value")).write.mode("append" if i else "errorifexists").options(**options).text(path)


class _Stream:
    """The bytes of a file, plain or gzip of one or many members, unpacked as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step, self.held = memoryview(data), 0, step, bytearray()
        self.unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + self.step]
        self.at += len(part)
        while self.unzip and len(part):
            self.held += self.unzip.decompress(part)
            part = self.unzip.unused_data
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
        self.held += b"" if self.unzip else part
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed over; None at the end of the file."""
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes, payloads: bool, others: bool = False):
    """The responses and revisits of one archive, as tuples in the order of SCHEMA; others: all other records, too."""
    stream = _Stream(data)
    while (top := stream.until(b"\r\n\r\n")) is not None:
        if not (top := top.lstrip(b"\r\n")):
            continue  # the blank lines after a record
        text = top.decode("utf-8", "replace")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.split("\r\n")[1:])}
        block = stream.take(int(head.get("content-length", 0)))
        kind = head.get("warc-type")
        bare = lambda x: None if x is None else x.strip("<>")
        if kind not in RESOLVED:
            if others:
                yield (bare(head.get("warc-record-id")), kind or "", None, bare(head.get("warc-target-uri")), head.get("warc-date"), None, len(block), None, None, True, head.get("content-type"), None, top, block if payloads else None)
            continue
        again = kind == "revisit"
        web = head.get("content-type", "").startswith("application/http")
        cut = block.find(b"\r\n\r\n") + 4 if web else 0
        http = (block[:cut] if cut > 3 else block) if web else None
        body = None if again else block[len(http or b"") :]
        own = None if again else base64.b32encode(hashlib.sha1(body).digest()).decode()
        said = head.get("warc-payload-digest", "")
        said = said.removeprefix("sha1:") if said.startswith("sha1:") else None  # of other kinds of digest the SHA-1 takes the place
        size = head.get("x-payload-length")
        intact = again or (said is None or own == said) and (size is None or len(body) == int(size))
        number = lambda x: None if x is None else int(x)
        yield (
            bare(head.get("warc-record-id")), kind, number(head.get("x-source-id")), bare(head.get("warc-target-uri")), head.get("warc-date"), said or own,
            number(size) if size is not None or again else len(body), number(head.get("x-refers-to-source-id")), bare(head.get("warc-refers-to")),
            intact, head.get("content-type"), http, None, body if payloads else None,
        )


def read(spark: SparkSession, path: str, payloads: bool = True, others: bool = False) -> DataFrame:
    """The responses and revisits under path, in SCHEMA; payload is null in revisits and where payloads is False. others: records of
    all other types, too, with header (as it was written) and payload (their block)."""
    kinds = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in SCHEMA])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse(content.as_py(), payloads, others):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*{.gz,.warc}").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, SCHEMA)


def _resolved(records: DataFrame, min_bytes: int) -> DataFrame:
    rows = written(records.withColumn("row", F.monotonically_increasing_id()), "records", compression="zstd")  # numbers differ if the rows are read twice
    heads = rows.drop("payload", "http", "header")
    # every record meets a decision; those of other types decide for themselves
    other = heads.filter(~F.col("record_type").isin(*RESOLVED)).select("row", "record_type", "refers_to", "refers_to_record")
    decided = written(resolve(heads.filter(F.col("record_type").isin(*RESOLVED)), min_bytes).unionByName(other), "decided")
    return rows.drop("record_type", "refers_to", "refers_to_record").join(decided, "row").select(SCHEMA.names)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, **names) -> None:
    """Writes deduplicated archives of pages."""
    write(_resolved(records_of(pages, **names), min_bytes), path)


def rewrite(spark: SparkSession, source: str, path: str, min_bytes: int = 0) -> None:
    """Reads the archives under source and writes deduplicated ones, with fresh headers, to path."""
    records, full = read(spark, source, others=True), F.col("record_type") == "response"
    true = records.withColumns({"payload_digest": F.when(full, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")), "payload_bytes": F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))})
    write(_resolved(true, min_bytes), path)


def archived(pages: DataFrame, min_bytes: int = 0, path: str | None = None, **names) -> DataFrame:
    """Archives pages under path (a new shared folder by default) and reads the archives' headers back."""
    path = path or new_path(pages.sparkSession, "warc")
    archive(pages, path, min_bytes, **names)
    return read(pages.sparkSession, path, payloads=False)
