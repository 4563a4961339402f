"""WARC archives: a writer with revisit records and a salvage reader.

Writing: one gzip member per record, through Spark's text sink, so archives are committed by Spark's protocol into any
store it can write.  The sink ends each row with a separator; that separator is an empty gzip member,
which every gzip reader skips.  Of records with equal payloads of at least ``SMALLEST_REVISIT`` bytes the one
with the smallest id is ``response``, the others ``revisit`` it; smaller ones are all ``response``.

Reading: every member (or plain record) is checked: inflation and its checksum, version line, content length,
record end, payload digest.  After a failed check the reader searches for the next valid member or version line,
goes on there, and logs the bytes in between as a quarantined gap.  Within a member the search goes over its inflated content (a gap there
has the member's place, its reason tells the bytes of the content); of a member that cannot be inflated to its end, what was inflated
before the fault is read.

Defined results: a null payload is empty; a null id is written as ``null`` and read as null, and is never the smallest;
rows that share the smallest id of their payload are all responses; line breaks in a URL become spaces, a null URL
becomes the record's own name; an empty table gives no record; other columns are not read.
Archives are read whole, one at a time per task; the writer ends an archive after ``CHUNKS`` chunks of members, each as long as ``CHUNK_BYTES`` or one
record.  A member that inflates to more than ``MOST_INFLATED`` bytes is read up to there.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

SMALLEST_REVISIT = 100
#: Bytes of members that are written as one row of the text sink, and rows of an archive.
CHUNK_BYTES, CHUNKS = 1 << 21, 16
#: Bytes of a member's content at most.
MOST_INFLATED = 1 << 30
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
#: A gzip member that holds nothing.
EMPTY_MEMBER = gzip.compress(b"", 9, mtime=0)
DATE = b"2024-01-01T00:00:00Z"
NAME = "urn:page:"
STEP = 1 << 16
FIELDS = (
    "kind string, path string, start long, length long, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def build_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool
) -> bytes:
    """An uncompressed WARC/1.1 record; a revisit has the HTTP head but no payload."""
    name = f"{NAME}{'null' if page_id is None else page_id}"
    target = re.sub(r"[\r\n]+", " ", url or name)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if revisit else head + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <%s>" % name.encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + target.encode(),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
    ]
    if revisit:
        lines.append(b"WARC-Refers-To: <%s%d>" % (NAME.encode(), refers_to))
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("size")
    )
    large = rows.where(F.col("size") >= SMALLEST_REVISIT).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and first_id is not null").select(F.col("digest").alias("g_digest"), "first_id")
    groups = scratch.keep(groups, "payload-groups")
    # payloads that surely occur once need no join, so that only possible copies are shuffled, if the groups are too many to be broadcast
    marked = scratch.sifted(rows, F.col("digest"), scratch.sieve(groups, F.col("g_digest")), "copied")
    columns = ["page_id", "url", "payload", "digest", "size"]
    joined = marked.where("copied").join(groups, F.col("digest") == F.col("g_digest"), "left")
    same = F.col("page_id").eqNullSafe(F.col("first_id"))
    refers_to = F.when(same, F.lit(None)).otherwise(F.col("first_id")).cast("long").alias("refers_to")
    return joined.select(*columns, refers_to).unionByName(marked.where("not copied").select(*columns, F.lit(None).cast("long").alias("refers_to")))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Write the archives of ``pages`` into the folder ``path``."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, length = [], 0
        for part in scratch.pieces_of(batches, 256):
            for i, url, data, digest, size, ref in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held.append(gzip.compress(build_record(i, url, data, digest, size, ref, ref is not None), 6, mtime=0))
                length += len(held[-1])
                if length >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, length = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    rows = with_roles(pages, **columns).mapInArrow(members, "value binary")
    (
        rows.select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("compression", "none")
        .option("maxRecordsPerFile", CHUNKS)
        .text(path)
    )


class BadRecord(ValueError):
    """A check of a record failed."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, payload, end) of the record that starts at ``at``; raises BadRecord."""
    if not data.startswith(b"WARC/1.", at):
        raise BadRecord("no version line")
    fields: dict[str, str] = {}
    line_end = data.find(b"\r\n", at)
    while True:  # line by line, so that a bad header is left at its first bad line, however long headers may be
        begin, line_end = line_end + 2, data.find(b"\r\n", line_end + 2) if line_end >= 0 else -1
        if line_end < 0:
            raise BadRecord("header has no end")
        if line_end == begin:
            break
        name, colon, value = data[begin:line_end].partition(b":")
        if not colon:
            raise BadRecord("header line without a colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise BadRecord("no content length")
    start, end = line_end + 2, line_end + 2 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise BadRecord("record end is not where the content length says")
    block = data[start:end]
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise BadRecord("HTTP head has no end")
        length = re.search(rb"(?im)^Content-Length:\s*(\d+)\s*$", http)
        fields["http-content-length"] = length[1].decode() if length else ""
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if fields.get("warc-type") != "revisit" and algorithm == "sha256" and hashlib.sha256(payload).hexdigest() != digest:
        raise BadRecord("payload digest differs")
    return fields, payload, end + 4


def inflate(data: bytes, at: int, careful: int | None = None) -> tuple[bytes, int, str]:
    """(content, end, fault) of the gzip member at ``at``; with a fault, what was inflated before it and where it showed.
    From ``careful`` on single bytes are fed, as a failing step returns nothing."""
    engine, out, fed, length = zlib.decompressobj(31), [], at, 0
    while not engine.eof:
        if length > MOST_INFLATED:
            return b"".join(out), fed, "gzip member is too long"
        if fed >= len(data):
            return b"".join(out), len(data), "gzip member has no end"
        step = STEP if careful is None or fed < careful else 1
        try:
            out.append(engine.decompress(data[fed : fed + step]))
            length += len(out[-1])
        except zlib.error as e:
            if step > 1:
                return inflate(data, at, fed)
            return b"".join(out), fed, f"gzip: {e}"
        fed += step
    return b"".join(out), min(fed, len(data)) - len(engine.unused_data), ""


def _opens(data: bytes, at: int) -> bool:
    """Does a member that begins with a record, or an empty one, open here?"""
    engine = zlib.decompressobj(31)
    try:
        start = engine.decompress(data[at : at + 1024], 16)
    except zlib.error:
        return False
    return start.startswith(b"WARC/1.") or engine.eof and not start


def next_start(data: bytes, at: int) -> int:
    """The next offset from ``at`` on where a valid member or a version line starts (or the end)."""
    for m in re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r\n").finditer(data, at):
        if data[m.start()] != 0x1F or _opens(data, m.start()):
            return m.start()
    return len(data)


def records_in(content: bytes) -> Iterator[tuple]:
    """('record', start, end, fields, payload) and ('gap', start, end, reason, None) of a member's content, in order."""
    at = 0
    while at < len(content):
        try:
            fields, payload, end = parse_record(content, at)
            yield "record", at, end, fields, payload
        except BadRecord as e:
            line = VERSION_LINE.search(content, at + 1)
            end = line.start() if line else len(content)
            yield "gap", at, end, str(e), None
        at = end


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', start, end, fields, payload) and ('gap', start, end, reason, None), in order."""
    at = 0
    # after a faulty member the search goes over its own bytes again, where stored blocks may show records that were inflated from it
    known, known_end = set(), 0
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b", at):
                content, end, fault = inflate(data, at)
                for kind, a, b, found, payload in records_in(content):
                    if kind == "record":
                        yield "record", at, end, found, payload
                        if fault:
                            known.add(hashlib.sha256(content[a:b]).digest())
                            known_end = max(known_end, end)
                    elif not fault or b < len(content):  # what a fault cut off is in the gap of the fault
                        yield "gap", at, end, f"{found} (bytes {a} to {b} of the content)", None
                if fault:
                    raise BadRecord(fault)
            elif data.startswith(b"WARC/", at):
                fields, payload, end = parse_record(data, at)
                if at >= known_end or hashlib.sha256(data[at:end]).digest() not in known:
                    yield "record", at, end, fields, payload
            else:
                raise BadRecord("neither a member nor a version line")
            at = end
        except BadRecord as e:
            end = next_start(data, at + 1)
            yield "gap", at, end, str(e), None
            at = end


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (``kind``) of all archives in a folder; without ``payloads`` that column is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in FIELDS.split(", ")])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

        for part in scratch.pieces_of(batches, 1):
            rows, held = [], 0
            archive, data = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            for kind, start, end, fields, payload in salvage(data):
                if kind == "gap":
                    rows.append((kind, archive, start, end - start, fields, None, None, None, None, None, None, None))
                    continue
                bare = lambda name, f=fields: f.get(name, "").strip("<>") or None
                revisit = fields.get("warc-type") == "revisit"
                if revisit:
                    size = int(fields.get("http-content-length") or 0)
                    digest = fields.get("warc-payload-digest", "").partition(":")[2]
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                rows.append(
                    (kind, archive, start, end - start, None, fields.get("warc-type"), bare("warc-record-id"), fields.get("warc-target-uri"),
                     bare("warc-refers-to"), size, digest, payload if payloads and not revisit else None)
                )
                held += len(payload) if payloads else 0
                if len(rows) >= 1000 or held > 1 << 24:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, FIELDS)


def _page(name: str):
    tail = F.substring_index(F.col(name), ":", -1)
    return F.when(tail == "null", F.lit(None)).otherwise(tail).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` to the shared scratch folder and read every record back; a gap in them is an error."""
    spark = pages.sparkSession
    path = scratch.new_path(spark, "warc")
    write_archives(pages, path)
    gap = F.raise_error(F.concat(F.lit("gap in an archive just written: "), "path", F.lit(": "), "reason"))
    records = read_archives(spark, path, payloads=False).where(F.when(F.col("kind") == "record", True).otherwise(gap.cast("boolean")))
    return records.select(
        _page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to")
    )


def oracle_sql() -> str:
    return f"""
with p as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes,
                  sha256(coalesce(html, '')) as payload_digest from pages),
g as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {SMALLEST_REVISIT} and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {SMALLEST_REVISIT} and page_id <> first_id then first_id end as refers_to
from g"""
