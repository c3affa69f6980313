"""WARC archives: a writer with revisit records, and a salvage reader that recovers what stands after damage."""

from __future__ import annotations

import hashlib
import logging
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, keep, shared_dir, small_batches, table

_LOG = logging.getLogger(__name__)
END = "\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
READ = "file string, at long, inner long, bytes long, problem string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"


#: Pages of up to so many bytes share an archive, so many of them at most; a larger one has an archive of its own.
SMALL, TOGETHER = 1 << 20, 1000
#: A member holds fewer bytes than this, so that the last byte of the length at its end is 0. A longer record goes on in more members.
MEMBER = (1 << 24) - 1


def _header(kind: str, date: str | None) -> list:
    lit, col = F.lit, F.col
    return [
        lit("WARC/1.1\r\nWARC-Type: "), lit(kind),
        lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(col("page_id").cast("string"), lit("")),
        lit(">\r\nWARC-Date: "), lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(col("url"), lit("")), r"[\r\n]", " "),
        lit("\r\nWARC-Payload-Digest: sha256:"), col("_digest"),
    ]


def _members(batches):
    """Each record as gzip members without their very last byte."""
    for batch in batches:
        out = []
        for record in batch.column(0):
            data, parts = record.as_py(), []
            for at in range(0, len(data), MEMBER):
                packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                parts += [packed.compress(data[at : at + MEMBER]), packed.flush()]
            out.append(b"".join(parts)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, least: int = 100, compression: str = "gzip", date: str | None = None) -> None:
    """Write a WARC record for each row of pages(page_id, url, html) below `path`, with Spark's own text writer: one gzip member for each
    record, or plain archives with compression "none". `date` is the records' WARC-Date (now, unless given).

    The payload is the html in UTF-8 (null: empty). Of records whose equal payloads have at least `least` bytes, those with the
    smallest page_id are responses and the others revisits without payload, which carry its length and digest; smaller payloads are
    all responses. Rows without page_id are revisits where a row with page_id has their payload, else responses. A record's id names the
    page, so rows of one page_id share it. A table without rows writes archives without records. An archive holds at most TOGETHER
    records of SMALL bytes, or one larger record. The html is shuffled once, on its digest, by a join that adaptive execution can split
    where one payload has very many rows.
    """
    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(None).cast("string"))
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html")).withColumn("_bytes", F.octet_length("_html"))
    for folder, some, most in (("small", F.col("_bytes") <= SMALL, TOGETHER), ("large", F.col("_bytes") > SMALL, 1)):
        rows = pages.filter(some).withColumn("_digest", F.sha2(F.col("_html").cast("binary"), 256))  # equal payloads are in one of the two
        first = rows.filter(F.col("_bytes") >= least).groupBy("_digest").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first"))
        rows = rows.join(first.filter("_n > 1 AND _first IS NOT NULL").drop("_n"), "_digest", "left")
        again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
        revisit = F.concat(
            *_header("revisit", date), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("_first").cast("string"), F.lit(">\r\nWARC-Refers-To-Payload-Length: "), F.col("_bytes").cast("string"), F.lit("\r\nContent-Length: 0" + END),
        )
        response = F.concat(*_header("response", date), F.lit("\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END), F.col("_html"))
        record, between = rows.select(F.when(again, revisit).otherwise(response).alias("value")), END
        if compression == "gzip":  # the text writer puts the byte 0, with which each member ends, after each
            record, between = record.select(F.concat("value", F.lit(END)).cast("binary").alias("value")).mapInArrow(_members, "value binary"), "\0"
        record.select(F.col("value").cast("string")).write.option("lineSep", between).option("maxRecordsPerFile", most).text(f"{path}/{folder}")


_VERSION = re.compile(rb"WARC/1\.\d\r\n")
_AT_LINE = re.compile(rb"(?<=\n)WARC/1\.\d\r\n")
_FIELD = re.compile(rb"([^\s:]+):[ \t]*(.*)")


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at `at`, where it ends, and what is wrong with it."""
    if not _VERSION.match(data, at):
        return None, at, "no version line"
    body = data.find(b"\r\n\r\n", at)
    if body < 0:
        return None, at, "header without end"
    if _AT_LINE.search(data, at + 1, body):
        return None, at, "header cut short"
    fields = {m[1].lower(): m[2].strip() for x in data[at:body].split(b"\r\n")[1:] if (m := _FIELD.fullmatch(x))}
    if not re.fullmatch(rb"\d{1,12}", fields.get(b"content-length", b"")):
        return None, at, "no content length"
    body, length = body + 4, int(fields[b"content-length"])
    payload, end = data[body : body + length], body + length
    if len(payload) < length:
        return None, at, "payload cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no record end after the payload"
    digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("latin-1")
    kind = fields.get(b"warc-type", b"").decode("latin-1")
    if kind != "revisit" and digest and hashlib.sha256(payload).hexdigest() != digest:
        return None, at, "payload digest differs"
    name = lambda key: fields.get(key, b"").strip(b"<>").removeprefix(b"urn:page:").decode("utf-8", "replace") or None
    size = fields.get(b"warc-refers-to-payload-length", b"") if kind == "revisit" else b"%d" % length
    return {
        "record_id": name(b"warc-record-id"), "record_type": kind, "refers_to": name(b"warc-refers-to"),
        "payload_bytes": int(size) if size.isdigit() else None,
        "payload_digest": digest or hashlib.sha256(payload).hexdigest(), "payload": payload,
    }, end + 4, ""


def _plain(data: bytes, at: int = 0):
    """Yields (offset, bytes, problem, record) over plain records up to the end, or up to a gzip member where they should go on."""
    while at < len(data):
        record, end, problem = _record(data, at)
        if record:
            yield at, end - at, None, record
        else:
            if data[at : at + 3] == GZIP and _unpack(data, at)[2] is None:
                return
            end = at + 1
            while end < len(data):
                m, z = _VERSION.search(data, end), data.find(GZIP, end)
                end = min(x for x in (m.start() if m else len(data), z if z >= 0 else len(data)))
                if end < len(data) and (_unpack(data, end)[2] is None if data[end : end + 3] == GZIP else _record(data, end)[0]):
                    break
                end += 1
            end = min(end, len(data))
            yield at, end - at, problem, None
        at = end


def _unpack(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The plain bytes of the gzip member at `at` as far as they can be read, where it ends, and what is wrong with it."""
    unpack, parts, fed, problem = zlib.decompressobj(31), [], at, None
    while not unpack.eof and fed < len(data) and not problem:
        try:
            parts.append(unpack.decompress(data[fed : fed + 4096]))
        except zlib.error as e:
            problem = f"gzip member: {e}"[:80]
        fed += 4096
    end = min(fed, len(data)) - len(unpack.unused_data)
    return b"".join(parts), end, problem or (None if unpack.eof else "gzip member cut short")


def _continued(data: bytes, at: int, begun: bytes) -> tuple[dict | None, int]:
    """The record that begins so and goes on in the members from `at`, and where the last of them ends."""
    length = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,12})", begun[: begun.find(b"\r\n\r\n")], re.I)
    wanted, parts = begun.find(b"\r\n\r\n") + 8 + int(length[1]) - len(begun), [begun]
    while wanted > 0 and data[at : at + 3] == GZIP:
        more, at, broken = _unpack(data, at)
        if broken:
            break
        parts.append(more)
        wanted -= len(more)
    return _record(b"".join(parts), 0)[0], at


def salvage(data: bytes):
    """Yields (offset, inner, bytes, problem, record) over an archive: plain records, gzip members of one or more records, or both.

    problem is None for a record. After a record that fails its checks the next valid version line or member is sought, and the bytes
    up to it are one quarantined gap; of a broken member, the records that could still be unpacked are returned (each must pass its
    own checks), then a gap from its start to the next valid member or version line. A record may go on in the next members. `offset` is
    that of the member or plain record in the file; `inner` that within the unpacked member, -1 for what is not in a member.
    """
    at = 0
    while at < len(data):
        if data[at : at + 3] != GZIP:
            start = at
            for start, size, problem, record in _plain(data, at):
                yield start, -1, size, problem, record
                at = start + size
            continue
        plain, end, broken = _unpack(data, at)
        for inner, size, problem, record in _plain(plain):
            if problem == "payload cut short" and not broken:
                whole, further = _continued(data, end, plain[inner:])
                if whole:
                    yield at, inner, further - at, None, whole
                    end = further
                    break
            if record or not broken:
                yield at, inner, size, problem, record
        if broken:
            end = at + 1
            while end < len(data):
                m, z = _VERSION.search(data, end), data.find(GZIP, end)
                end = min(m.start() if m else len(data), z if z >= 0 else len(data))
                if end < len(data) and (_unpack(data, end)[2] is None if data[end : end + 3] == GZIP else _record(data, end)[0]):
                    break
                end += 1
            end = min(end, len(data))
            yield at, -1, end - at, broken, None
        at = end


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of all archives below `path`; problem is null for a record, and a gap's reason else.

    Archives are read whole, one by one, so the writer keeps them small; their members are unpacked one by one. Gaps have no record
    columns. Folders below `path` are read too.
    """
    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                for at, inner, size, problem, r in salvage(data.as_py()):
                    r = r or {}
                    fields = (r.get("record_id"), r.get("record_type"), r.get("refers_to"), r.get("payload_bytes"), r.get("payload_digest"))
                    rows.append((name, at, inner, size, problem, *fields, *([r.get("payload")] if payload else [])))
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if payload else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])

    schema = READ + (", payload binary" if payload else "")
    small_batches(spark)  # batches are also bounded by bytes, so archives come one by one or a few at a time
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, schema)


def quarantined(found: DataFrame, expected: int | None = None) -> DataFrame:
    """Log the gaps of what read_warc() returned and return them: file, at, bytes, problem. Raises if records are not as many as `expected`."""
    gaps = found.filter("problem IS NOT NULL").select("file", "at", "bytes", "problem")
    n, records = gaps.count(), found.filter("problem IS NULL").count()
    for r in gaps.orderBy("file", "at").limit(20).collect():
        _LOG.warning("quarantined %d bytes at %d of %s: %s", r["bytes"], r["at"], r["file"], r["problem"])
    if n > 20:
        _LOG.warning("%d gaps in all", n)
    if expected is not None and records != expected:
        raise ValueError(f"{expected} records were written, {records} were read, with {n} gaps")
    return gaps


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", table(spark, sf_dir, "pages")
    write_warc(pages, path)
    found = keep(read_warc(spark, path), "warc-records")
    drop_path(spark, path)
    quarantined(found, pages.count())
    return found.filter("problem IS NULL").select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to")
    )


QUERIES = {"op6_warc": op6_warc}
ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""
}
