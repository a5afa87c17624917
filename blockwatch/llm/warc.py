"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Writer. Every page becomes one record. Payloads are equal if their SHA-256 and length are; of equal
payloads of at least ``least`` bytes the record with the largest page_id is the ``response``, the
others are ``revisit`` records that name it, with the HTTP header but without the payload. Each
record is a gzip member of its own. Archives are written by Spark's text writer, so tasks commit
their files whole, on any file system that Spark writes to: the bytes of a member are one value, a
NUL byte (padding that gzip readers skip) stands behind each, and a ``warcinfo`` record begins each
file. Files hold ARCHIVE_RECORDS records at most.

Salvage reader. A file is a sequence of gzip members or plain records (also mixed). A member must
inflate to its end with its check sum; a record must have its version line, a Content-Length that
the two line ends behind the block confirm, and blocks and payloads that match their digests. When a
check fails, the reader searches for the next place that is a valid member or version line, goes on
from there, and returns the byte range in between as a gap with the reason. A member or framed record
of known length whose contents fail is a gap by itself: nothing inside it is taken for a record.

Null and empty html are empty payloads. A null page_id stands below all others; rows with the same
payload and the same largest page_id are all responses. A null url has no target. Control characters,
blanks and ``%`` in urls are percent-encoded and decoded again. Damaged, empty and foreign files give
gaps, no error; files over 2 GB are refused by Spark's binary reader. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.common import lean, query, table
from blockwatch.session import ensure_checkpoint_dir

#: Records of a file, the first one a warcinfo; least bytes of a payload that is stored once.
ARCHIVE_RECORDS, LEAST = 8192, 0
#: The tables have no crawl time: a fixed date keeps a repeated task's bytes the same.
DATE = "1970-01-01T00:00:00Z"
#: Bytes given to zlib at a time, and rows of a batch handed back.
_CHUNK, _ROWS = 1 << 16, 1000
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
#: Fields that every record has.
_REQUIRED = ("warc-record-id", "warc-type", "warc-date")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_FILLED = re.compile(rb"[^\x00]")
_UNSAFE = re.compile(rb"[\x00-\x20%\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- writing ------------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
            ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def _safe(url: str) -> str:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m.group()[0], url.encode()).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The record of a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page_id)), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if url is not None:
        fields.append(("WARC-Target-URI", _safe(url)))
    if revisit:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", _REVISIT)]
        return _record("revisit", fields, http)
    return _record("response", fields, http + payload)


def info_record(name: str) -> bytes:
    block = b"software: corpus writer\r\nformat: WARC File Format 1.0\r\n"
    return _record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{name}>"), ("Content-Type", "application/warc-fields")], block)


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), refers_to and revisit of every page.

    The groups are reduced to one row each before they are joined back, and only groups of several
    pages are; a group with a third of all rows is one hot key of the larger side, which the
    adaptive join splits.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url",
                       F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    key = F.struct(F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("size"))
    groups = (own.select("page_id", key.alias("key")).where(F.col("key.size") >= least).groupBy("key")
              .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
              .select(F.col("key.sha").alias("sha"), F.col("key.size").alias("size"), "original"))
    copy = F.col("size").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return (own.withColumn("sha", F.sha2("payload", 256)).join(groups, "sha", "left")
            .select("page_id", "url", "payload", F.when(copy, F.col("original")).alias("refers_to"), copy.alias("revisit")))


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives of all pages, under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if n % ARCHIVE_RECORDS == 0:
                    out.append(_member(info_record(f"{record_id(row['page_id'])[1:-1]}:{n}")))
                    n += 1
                out.append(_member(page_record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"])))
                n += 1
            yield pa.record_batch({"member": pa.array(out, pa.binary())})

    members = with_originals(pages, least).mapInArrow(lean(run), "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path))


# ---- reading ------------------------------------------------------------------

class Damaged(Exception):
    """A check failed; ``end``: where the damaged record ends, if its length is known."""

    def __init__(self, why: str, end: int | None = None):
        super().__init__(why)
        self.end = end


def _inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """Contents and end of the gzip member at ``at``."""
    inflate, out = zlib.decompressobj(31), []
    while not inflate.eof:
        if at >= len(data):
            raise Damaged("member is cut off")
        piece = data[at:at + _CHUNK]
        try:
            out.append(inflate.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        at += len(piece)
    return b"".join(out), at - len(inflate.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields, names in small letters; folded lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode(errors="replace")
        elif b":" in line:
            k, v = line.split(b":", 1)
            name = k.strip().decode(errors="replace").lower()
            if name in out and name != "warc-concurrent-to":
                raise Damaged("header field is repeated")
            out[name] = v.strip().decode(errors="replace")
        else:
            raise Damaged("header line without a colon")
    return out


def _digest_fails(field: str | None, data: bytes) -> bool:
    if field is None or not field.lower().startswith("sha1:"):
        return False  # none given, or a kind that is not checked
    return field[5:].strip().upper() not in (base32_sha1(data), hashlib.sha1(data).hexdigest().upper())


def _plain(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record at ``at``: its row and its end."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", version.end() - 2)
    if head < 0:
        raise Damaged("header is cut off")
    fields = _fields(bytes(data[version.end():head]))
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no Content-Length")
    first = head + 4
    end = first + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block is cut off" if end + 4 > len(data) else "block does not end where it should")
    missing = [k for k in _REQUIRED if not fields.get(k)]
    if missing:
        raise Damaged(f"no {missing[0]}", end + 4)
    block = bytes(data[first:end])
    if _digest_fails(fields.get("warc-block-digest"), block):
        raise Damaged("block digest differs", end + 4)
    kind, payload = fields.get("warc-type", ""), block
    digest = fields.get("warc-payload-digest")
    size = None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
        size = int(said[1]) if said else None
    if kind == "revisit":
        payload = None
    elif _digest_fails(digest, payload):
        raise Damaged("payload digest differs", end + 4)
    else:
        digest, size = base32_sha1(payload), len(payload)
    target = fields.get("warc-target-uri")
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "date": fields.get("warc-date"),
            "target_uri": None if target is None else unquote_to_bytes(target).decode(errors="replace"),
            "refers_to": fields.get("warc-refers-to"), "payload_bytes": size,
            "payload_digest": digest.split(":")[-1].upper() if digest else None, "payload": payload}, end + 4


def _member_rows(data: memoryview, at: int) -> tuple[list[dict], int]:
    """Records of the member at ``at`` and its end."""
    body, end = _inflated(data, at)
    out, p = [], 0
    try:
        while p < len(body):
            row, p = _plain(body, p)
            out.append(row)
    except Damaged as e:
        raise Damaged(f"in a member: {e}", end) from None
    if not out:
        raise Damaged("empty member", end)
    return out, end


def _valid_at(data: bytes, view: memoryview, at: int) -> tuple[list[dict], int]:
    if data[at:at + 3] == _MAGIC:
        return _member_rows(view, at)
    row, end = _plain(data, at)
    return [row], end


def salvage(data: bytes) -> Iterator[dict]:
    """Rows of a file: records (``kind`` record) and byte ranges without one (``kind`` gap), in order."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at] == 0:  # padding
            more = _FILLED.search(data, at)
            at = more.start() if more else len(data)
            continue
        try:
            rows, end = _valid_at(data, view, at)
        except Damaged as e:
            why, end = str(e), e.end
            # The length is trusted only if something that can follow a record does.
            if end is None or not (end >= len(data) or data[end] == 0 or _START.match(data, end)):
                end, p = len(data), at + 1
                while (m := _START.search(data, p)) is not None:
                    try:
                        _valid_at(data, view, m.start())
                    except Damaged as other:
                        if other.end is None:
                            p = m.start() + 1
                            continue
                    end = m.start()
                    break
            yield {"kind": "gap", "start": at, "end": end, "reason": why}
            at = end
            continue
        for row in rows:
            yield row | {"kind": "record", "start": at, "end": end}
        at = end


_COLUMNS = ("path string, kind string, start bigint, end bigint, reason string, record_type string, record_id string, "
            "date string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps of all files under ``path``; with ``payloads`` also the payload of each record."""
    schema = _COLUMNS + (", payload binary" if payloads else "")
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for row in salvage(content.as_py()):
                    size += len(row.get("payload") or b"") if payloads else 0
                    rows.append({k: row.get(k) for k in arrow.names} | {"path": file.as_py()})
                    if len(rows) == _ROWS or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(run), schema)


def records(read: DataFrame) -> DataFrame:
    return read.where("kind = 'record'").drop("kind", "reason")


def gaps(read: DataFrame) -> DataFrame:
    """The log of byte ranges that hold no valid record."""
    return read.where("kind = 'gap'").select("path", "start", "end", "reason")


# ---- the query ------------------------------------------------------------------

#: Four base32 letters of each five hexadecimal digits.
_B32 = ("array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: "
        "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (g * 5 + 1)::INT, 5))::INT >> s::INT) & 31) + 1)::INT, 1)), '')), '')")

_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS original FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM m
"""


@query("op12_warc", _SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return records(read_archives(spark, path)).where("record_type IN ('response', 'revisit')").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))
