"""ARC archives, and their conversion to WARC (operator 11).

An ARC file begins with a version block that says how its header lines are to be read (five
fields in version 1, ten in version 2); each header line declares the length of what follows. The
converter makes of every record what WARC asks for beyond that: an identifier, an ISO time, a
type, digests, and a reference where the same payload is already there. Archives are written and
read by Spark, a row being one archive, so that they may lie wherever Spark reads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, slices

#: Fields of a header line before and after which nothing but the URL may hold a space.
FIELDS = {1: 5, 2: 10}
DEFINITION = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: A header line is not read beyond this.
LONGEST_LINE = 65_536
END = b"\r\n\r\n"
PAGE_ID = b"X-Page-Id"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DAMAGE = (EOFError, gzip.BadGzipFile, zlib.error)


class Record(NamedTuple):
    """One record of an ARC file. ``problem``: truncated or unreadable."""

    offset: int
    url: bytes
    ip: bytes
    date: str
    mime: bytes
    block: bytes
    problem: str | None = None


def opened(content: bytes) -> io.BufferedIOBase:
    """A plain or gzip archive, of one member or of one for each record, as a stream."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def header(line: bytes, version: int) -> list[bytes] | None:
    """The fields of a header line of this version, or None if it is none."""
    fields = line.rstrip(b"\r\n").rsplit(b" ", FIELDS[version] - 1)
    good = len(fields) == FIELDS[version] and fields[-1].isdigit() and fields[2].isdigit() and len(fields[2]) in (12, 14) and b":" in fields[0]
    return fields if good else None


def iso(date: bytes) -> str | None:
    """An ARC date, of 14 digits or of 12 without seconds, as WARC writes it."""
    try:
        return datetime.strptime(date.decode().ljust(14, "0"), "%Y%m%d%H%M%S").isoformat() + "Z"
    except ValueError:
        return None


def read_arc(content: bytes, name: str) -> Iterator[tuple[str, Record]]:
    """The name that an archive's version block gives it (``name`` if there is none), and its records.

    Lengths are believed, whatever the content looks like. Bytes where a header line should stand
    and none does make an unreadable record; a last record shorter than it says is truncated, and
    so is one behind which the stream is damaged.
    """
    stream, version, made, junk, at = opened(content), 1, "1970-01-01T00:00:00Z", [], 0
    lost = lambda: (name, Record(at, b"", b"", made, b"application/octet-stream", b"".join(junk), "unreadable"))
    try:
        while line := stream.readline(LONGEST_LINE):
            start = stream.tell() - len(line)
            fields = header(line, version)
            if line.startswith(b"filedesc://"):
                version = 2 if len(line.split()) == FIELDS[2] else 1
                fields = header(line, version)
            if fields is None:
                if line.strip(b"\r\n") or junk:
                    at = at if junk else start
                    junk.append(line)
                continue
            if junk:
                yield lost()
                junk = []
            size = int(fields[-1])
            block = stream.read(size)
            if fields[0].startswith(b"filedesc://"):
                name, made = fields[0][len(b"filedesc://") :].decode("utf-8", "replace"), iso(fields[2]) or made
                said = block.split(b" ", 1)[0]
                version = int(said) if said in (b"1", b"2") else version
            else:
                yield name, Record(start, fields[0], fields[1], iso(fields[2]) or made, fields[3], block, "truncated" if len(block) < size else None)
    except DAMAGE:
        junk.append(b"")
        at = at or stream.tell()
    if junk:
        yield lost()


def http(block: bytes) -> tuple[bytes, bytes]:
    """Headers, with the empty line behind them, and payload of an HTTP response; no headers if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [at + len(x) for x in (END, b"\n\n") if (at := block.find(x)) >= 0]
    cut = min(ends, default=len(block))
    return block[:cut], block[cut:]


def field(headers: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", headers)
    return found and found[1]


def identifier(name: str, record: Record) -> str:
    """The same for the same record of the same archive, however often it is converted."""
    h = hashlib.sha256(b"\0".join([name.encode(), b"%d" % record.offset, record.url, record.date.encode()])).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}>"


def warc_type(record: Record) -> tuple[str, bytes]:
    """Type and content type: what a server said is a response, other content a resource."""
    if record.problem == "unreadable":
        return "metadata", record.mime
    if record.block.startswith(b"HTTP/"):
        return "response", b"application/http; msgtype=response"
    return "resource", b"text/dns" if record.url.startswith(b"dns:") else record.mime


def warc_record(fields: list[tuple[str, str | bytes | None]], block: bytes) -> bytes:
    """A record without the two line ends behind it; fields without a value are left out."""
    lines = [b"%s: %s" % (k.encode(), v.encode() if isinstance(v, str) else v) for k, v in [*fields, ("Content-Length", str(len(block)))] if v]
    return b"\r\n".join([b"WARC/1.1", *lines]) + END + block


def digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def convert_record(name: str, record: Record, refers: dict | None) -> bytes:
    """A record as WARC; ``refers`` (id, uri, date): the record that has its payload."""
    kind, mime = warc_type(record)
    headers, payload = http(record.block)
    block = headers if refers else record.block
    about = [
        ("WARC-Type", "revisit" if refers else kind), ("WARC-Record-ID", identifier(name, record)), ("WARC-Date", record.date),
        ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip if record.ip not in (b"0.0.0.0", b"-") else None),
        ("WARC-Payload-Digest", digest(payload) if kind == "response" else None), ("WARC-Block-Digest", digest(block)),
        ("WARC-Truncated", "length" if record.problem == "truncated" else None), ("Content-Type", mime),
    ]
    if refers:
        about += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Target-URI", refers["uri"]), ("WARC-Refers-To-Date", refers["date"])]
    return warc_record(about, block)


def read_warc(content: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes, str | None]]:
    """Offset, named fields (in lower case), block and problem of every record, by declared lengths."""
    stream = opened(content)
    try:
        while line := stream.readline(LONGEST_LINE):
            if not line.startswith(b"WARC/"):
                continue
            start, fields, last = stream.tell() - len(line), {}, ""
            while (line := stream.readline(LONGEST_LINE)).strip():
                if line[:1] in b" \t" and last:
                    fields[last] += b" " + line.strip()
                else:
                    last, _, value = line.partition(b":")
                    last = last.decode("latin-1").strip().lower()
                    fields[last] = value.strip()
            size = int(fields["content-length"]) if fields.get("content-length", b"").isdigit() else 0
            block = stream.read(size)
            yield start, fields, block, "truncated" if len(block) < size else None
    except DAMAGE:
        yield stream.tell(), {}, b"", "unreadable"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of a folder's archives."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def put(archives: DataFrame, folder: str, end: str) -> None:
    """Rows as files of their own. Bytes pass through unchanged, and ``end`` closes each. On web pages
    level 4 takes a third of the default's time for 4 % more bytes."""
    rows = archives.select(F.col("value").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "FOUR").option("lineSep", end).text(folder)


def write_arc(pages: DataFrame, folder: str, name: str = "pages", archive_bytes: int = 32_000_000, fetched: str = "20240101000000") -> None:
    """``pages`` (page_id, url, html) as ARC files, one version and the other in turn.

    A file takes pages until it has ``archive_bytes``, so it is larger only by its last page. What
    was fetched is an HTTP response whose header says the page's id. Null html is empty; a null
    url is "unknown:"; white space and control characters of a url are escaped.
    """
    escape = lambda m: b"%%%02X" % m[0][0]

    def head(version: int, url: bytes, mime: bytes, size: int, check: bytes, at: int, archive: bytes) -> bytes:
        between = [b"200", check, b"-", b"%d" % at, archive] if version == 2 else []
        return b" ".join([url, b"0.0.0.0", fetched.encode(), mime, *between, b"%d\n" % size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, size, nth, version, archive = TaskContext.get().partitionId(), [], 0, 0, 1, b""
        for batch in slices(batches):
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    version, archive = 1 + (task + nth) % 2, f"{name}-{task:06d}-{nth:06d}.arc.gz".encode()
                    origin = b"%d 0 quayside\n%s\n" % (version, DEFINITION[version])
                    parts = [head(version, b"filedesc://" + archive, b"text/plain", len(origin), b"-", 0, archive) + origin]
                    size, nth = len(parts[0]) + 1, nth + 1
                body = html or b""
                about = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", *([PAGE_ID + b": %d" % page_id] if page_id is not None else []), b"Content-Length: %d" % len(body)]
                block = b"\r\n".join(about) + END + body
                said = head(version, re.sub(rb"[\x00-\x20\x7f]", escape, url) if url else b"unknown:", b"text/html", len(block), b"%08x" % zlib.crc32(block), size, archive)
                if b":" not in said.split(b" ", 1)[0]:
                    said = b"unknown:" + said
                parts.append(said + block)
                size += len(parts[-1]) + 1
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts)], pa.binary())], ["value"])
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts)], pa.binary())], ["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").cast("binary"), F.col("html").cast("string").cast("binary"))
    put(rows.mapInArrow(run, "value binary"), folder, "\n")


ABOUT = "path string, offset long, record_id string, kind string, uri string, date string, page_id long, payload_bytes long, payload_digest string, problem string"


def scan_arc(archives: DataFrame) -> DataFrame:
    """What an archive's records are to become, without their content."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        for name, r in read_arc(content, path.rpartition("/")[2]):
            headers, payload = http(r.block)
            told = field(headers, PAGE_ID)
            yield path, r.offset, identifier(name, r), warc_type(r)[0], r.url.decode("utf-8", "replace"), r.date, int(told) if told else None, len(payload), digest(payload), r.problem

    return archives.mapInArrow(_each(rows, ABOUT), ABOUT)


def _each(rows, schema: str, most: int = 10_000):
    """A task that makes rows of every archive, ``most`` to a batch."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split(" ") for x in schema.split(", ")]
    told = pa.schema([(n, kinds[t]) for n, t in fields])

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), told, strict=True)], schema=told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for k in range(held.num_rows):
                made = []
                for row in rows(*(c[k].as_py() for c in held.columns)):
                    made.append(row)
                    if len(made) == most:
                        yield batch(made)
                        made = []
                if made:
                    yield batch(made)

    return run


def revisits(about: DataFrame, least: int = 100) -> DataFrame:
    """path, offset and refers (id, uri, date) of the responses whose payload another has.

    Of responses with equal payloads of at least ``least`` bytes the one with the smallest page_id
    (nulls last; ties: the smallest record id) stays a response.
    """
    full = about.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least) & F.col("problem").isNull())
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("record_id").alias("id"), "uri", "date")
    groups = full.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    # not joined by the length as well: equal digests suffice, and a join of its own shuffle can be split where a digest is hot
    rows = full.select("path", "offset", "record_id", "payload_digest").join(groups.select("payload_digest", "first"), "payload_digest")
    return rows.where(F.col("record_id") != F.col("first.id")).select("path", "offset", F.struct("first.id", "first.uri", "first.date").alias("refers"))


def convert(archives: DataFrame, decided: DataFrame, folder: str) -> None:
    """ARC files (path, content) as WARC files, one for each; ``decided`` (path, offset, refers) are revisits.

    Each begins with a warcinfo record that names the file it was made from. Truncated records
    say so, and unreadable bytes are kept as metadata records.
    """
    listed = decided.groupBy("path").agg(F.collect_list(F.struct("offset", "refers")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content, known = (c[k].as_py() for c in batch.columns)
                refers = {x["offset"]: x["refers"] for x in known or []}
                parts = []
                for name, r in read_arc(content, path.rpartition("/")[2]):
                    if not parts:
                        info = f"software: quayside\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()
                        of = Record(-1, b"", b"", r.date, b"", b"")
                        parts.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", identifier(name, of)), ("WARC-Date", r.date), ("WARC-Filename", re.sub(r"\.arc(\.gz)?$", "", name) + ".warc.gz"), ("Content-Type", "application/warc-fields")], info))
                    parts.append(convert_record(name, r, refers.get(r.offset)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(parts)], pa.binary())], ["value"])

    put(archives.join(listed, "path", "left").select("path", "content", "known").mapInArrow(run, "value binary"), folder, END.decode())


KEPT = "path string, offset long, record_id string, type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, intact boolean"


def scan_warc(archives: DataFrame) -> DataFrame:
    """The records of WARC files (path, content). ``intact``: the block has its declared length, and its
    digests are those of the headers. Of revisits payload_bytes is null, as the payload is elsewhere."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        for at, said, block, problem in read_warc(content):
            kind = said.get("warc-type", b"").decode()
            headers, payload = http(block) if kind in ("response", "revisit") else (b"", block)
            told, of, refers = field(headers, PAGE_ID), said.get("warc-payload-digest", b"").decode(), said.get("warc-refers-to")
            intact = not problem and said.get("warc-block-digest", b"").decode() in ("", digest(block)) and (kind != "response" or of == digest(payload))
            yield (
                path, at, said.get("warc-record-id", b"").decode(), kind, said.get("warc-target-uri", b"").decode("utf-8", "replace"), said.get("warc-date", b"").decode(),
                int(told) if told else None, None if kind == "revisit" else len(payload), of.removeprefix("sha256:") or None, refers and refers.decode(), intact,
            )

    return archives.mapInArrow(_each(rows, KEPT), KEPT)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits, these with the page_id (``refers_to``) and payload_bytes of what they refer to."""
    said = records.where("type = 'response'")
    found = said.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"))
    again = records.where("type = 'revisit'").join(found, "refers_to_id", "left").withColumn("payload_bytes", F.col("bytes")).drop("bytes")
    return said.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


def archive(pages: DataFrame, folder: str | None = None, least: int = 100, archive_bytes: int = 32_000_000) -> DataFrame:
    """Pages (page_id, url, html) to ARC files, these to WARC files, and their records as read back.

    The files stay in ``folder`` (``arc`` and ``warc`` in it), a new one in the shared folder if
    there is none. Only headers and digests are shuffled, and each archive once, compressed, to
    meet its list of revisits. An empty table gives no records; equal rows are records each.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "archives")
    write_arc(pages, f"{folder}/arc", archive_bytes=archive_bytes)
    old = files(spark, f"{folder}/arc")
    convert(old, revisits(checkpoint(scan_arc(old)), least), f"{folder}/warc")
    return resolved(checkpoint(scan_warc(files(spark, f"{folder}/warc"))))
