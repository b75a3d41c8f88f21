"""Legacy ARC archives to WARC.

An ARC file starts with a version block that names the fields of all later header lines: five in
version 1, ten in version 2. Records follow by their declared lengths. Each becomes a WARC
record with a synthesised id, timestamp, type and digests; records that repeat an earlier
payload become revisits. Archives are written and read by Spark's own sinks and sources, so any path
that Spark can reach will do. Each record is a gzip member of its own, so readers can seek to it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, stored, table

RECORDS = 2_000  # in a file: archives are read as whole files, of 2 GiB at most
MEMBER = (1 << 24) - 1  # bytes in a gzip member: the last byte of its length, and so of the member, is then 0

#: Fields of the header lines of ARC versions (fixed values of the format).
FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_FROM = 100  # bytes: shorter payloads are stored each time
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's namespace for URLs
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BLOCK = 4 << 20


def _members(data: bytes) -> bytes:
    """``data`` as a gzip member, or several if it is longer than MEMBER, without the zero byte at the end: Spark's text sink writes that one as its line separator."""
    out = []
    for at in range(0, max(1, len(data)), MEMBER):
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        out.append(packer.compress(data[at : at + MEMBER]) + packer.flush())
    return b"".join(out)[:-1]


def _write(rows: DataFrame, path: str, suffix: str, records: int) -> None:
    """Writes ``value`` (gzip members less their last byte) as files of ``records`` members, whose names end in ``suffix``."""
    rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", records).text(path, lineSep="\0")
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + suffix))


def _batches(values: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for value in values:
        out.append(value)
        size += len(value)
        if size > BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


# ---- ARC out: what a crawler of old would have left ---------------------------------------


def _arc_files(records: int) -> Callable:
    """Archives of so many members: a version block, then a record for each row. Odd tasks write version 2, with each record's place in its file."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        version = "1" if task % 2 == 0 else "2"
        n = offset = 0
        name = ""
        for b in batches:
            for key, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if n % records == 0:
                    name, offset = f"part-{task:05d}-{n // records}.arc", 0
                    block = f"{version} 0 legacy\n{' '.join(FIELDS[version])}\n".encode()
                    extra = "" if version == "1" else f" 200 - - 0 {name}"
                    yield (member := _members(f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{extra} {len(block)}\n".encode() + block + b"\n"))
                    offset += len(member) + 1
                    n += 1
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Archive-Key: {'' if key is None else key}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                safe = "".join(c if c > " " else "%20" for c in (url or "-")) or "-"
                extra = "" if version == "1" else f" 200 {hashlib.md5(http).hexdigest()} - {offset} {name}"
                yield (member := _members(f"{safe} 127.0.0.1 20240101000000 text/html{extra} {len(http)}\n".encode() + http + b"\n"))
                offset += len(member) + 1
                n += 1

    return lambda batches: _batches(members(batches))


def write_arc(pages: DataFrame, path: str, records: int = RECORDS) -> None:
    """Writes ``page_id``, ``url`` and ``html`` as ARC files of ``records`` members each.

    A null html is empty, a null or empty url a dash, a null page_id an empty key; repeated rows are records of their own, and other columns are left out.
    """
    rows = pages.select(F.col("page_id").cast("string"), "url", F.col("html").cast("binary"))
    _write(rows.mapInArrow(_arc_files(records), "value binary"), path, ".arc.gz", records)


# ---- ARC in ---------------------------------------------------------------------------------


class _Stream:
    """Bytes of a plain or gzipped archive, unpacked as far as they are asked for."""

    def __init__(self, raw: bytes | memoryview):
        self.raw, self.at, self.have, self.pos = memoryview(raw), 0, bytearray(), 0
        self.zip = zlib.decompressobj(31) if bytes(self.raw[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.pos > BLOCK:
            del self.have[: self.pos]
            self.pos = 0
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + (1 << 16)]
        if self.zip is None:
            self.have += part
            self.at += len(part)
            return True
        self.have += self.zip.decompress(part)
        self.at += len(part) - len(self.zip.unused_data)
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """To the next line feed, without it; None at the end."""
        seen = self.pos
        while (end := self.have.find(b"\n", seen)) < 0:
            before = self.pos
            seen = len(self.have)
            if not self._more():
                if self.pos == len(self.have):
                    return None
                end = len(self.have)
                break
            seen -= before - self.pos
        out = bytes(self.have[self.pos : end])
        self.pos = min(end + 1, len(self.have))
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) - self.pos < n and self._more():
            pass
        out = bytes(self.have[self.pos : self.pos + n])
        self.pos += len(out)
        return out


def arc_records(raw: bytes | memoryview) -> Iterator[tuple[dict, bytes]]:
    """(fields, content) of each record after the version block, by version and declared length; File-date is that of the archive.

    Raises ValueError for an unknown version, a header line of another number of fields, or a
    content shorter than declared. A URL may itself hold spaces: fields are counted from the right.
    """
    stream, fields, made = _Stream(raw), None, ""
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if fields is None:
            length = int(line.rsplit(b" ", 1)[1])
            block = stream.take(length)
            version = block.split(b" ", 1)[0].decode("ascii", "replace")
            if not line.startswith(b"filedesc://") or version not in FIELDS:
                raise ValueError(f"not an ARC version block: {line[:80]!r}")
            fields, made = FIELDS[version], line.decode("utf-8", "replace").split(" ")[2]
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"not a header line of {len(fields)} fields: {line[:80]!r}")
        head = dict(zip(fields, parts)) | {"File-date": made}
        content = stream.take(int(head["Archive-length"]))
        if len(content) != int(head["Archive-length"]):
            raise ValueError(f"content ends early: {line[:80]!r}")
        yield head, content


def _payload(content: bytes, kind: str = "") -> tuple[bytes, bytes]:
    """HTTP head and body; content without an HTTP status line is all body."""
    if content.startswith(b"HTTP/"):
        head, mid, body = content.partition(b"\r\n\r\n")
        if mid:
            return head + mid, body
    return b"", content


def _key(head: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"x-archive-key":
            return value.strip().decode() or None
    return None


def _parse(with_body: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "no", "key", "url", "ip", "date", "kind", "size", "digest", "head", "body"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                name = path.rsplit("/", 1)[-1]
                for no, (head, content) in enumerate(arc_records(memoryview(raw.as_buffer()))):
                    http, body = _payload(content)
                    keep = (http, body) if with_body else (b"", b"")
                    rows.append((name, no, _key(http), head["URL"], head["IP-address"], _warc_date(head["Archive-date"], head["File-date"]), head["Content-type"], len(body), hashlib.sha256(body).hexdigest(), *keep))
                    held += len(keep[1])
                    if held > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


RECORD = "file string, no bigint, key string, url string, ip string, date string, kind string, size bigint, digest string, head binary, body binary"


def read_arc(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """One row per ARC record below ``path``: file, no, key, url, ip, date, kind, size, digest, head, body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_parse(with_body), RECORD)


# ---- WARC out and in ------------------------------------------------------------------------


def _warc_date(date: str, otherwise: str = "") -> str:
    """An ARC date of 14, 12, 10 or 8 digits (what is missing is 0) in WARC's form; for another one that of the archive, else the epoch."""
    for text in (date, otherwise):
        if text.isdigit() and len(text) in (8, 10, 12, 14):
            try:
                return datetime.strptime(text.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                pass
    return "1970-01-01T00:00:00Z"


def _warc_record(r: dict) -> bytes:
    """A response, a revisit of a repeated payload, or, for content without an HTTP head, a resource."""
    repeat = r["refers_file"] is not None
    block = r["head"] if repeat else r["head"] + r["body"]
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if repeat else 'response' if r['head'] else 'resource'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'{r["file"]}#{r["no"]}')}>",
        f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha256:{r['digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {r['size']}",
    ]
    if repeat:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAMESPACE, r['refers_file'] + '#' + str(r['refers_no']))}>",
            f"WARC-Refers-To-Target-URI: {r['refers_url']}",
            f"WARC-Refers-To-Date: {r['refers_date']}",
            f"X-Refers-To-Key: {r['refers_key'] or ''}",
        ]
    lines += [f"Content-Type: {'application/http; msgtype=response' if r['head'] else r['kind']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _warc_files(records: int) -> Callable:
    """WARC records as gzip members; a warcinfo record opens each file."""
    info = b"software: quillspan legacy archive converter\r\nformat: WARC File Format 1.0\r\n"

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        n = 0
        for b in batches:
            for i in range(b.num_rows):
                r = {name: column[i].as_py() for name, column in zip(b.schema.names, b.columns)}
                if n % records == 0:
                    rid = uuid.uuid5(NAMESPACE, f"warcinfo:{r['file']}#{r['no']}")
                    yield _members(f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: {r['date']}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    n += 1
                yield _members(_warc_record(r))
                n += 1

    return lambda batches: _batches(members(batches))


def convert(spark: SparkSession, arc_path: str, warc_path: str, records: int = RECORDS) -> None:
    """Converts all ARC files below ``arc_path``, plain or gzipped, of 2 GiB at most each, to gzipped WARC files of ``records`` members below ``warc_path``.

    Ids are name-based on the file and the record's place in it, so a second run or a retried task
    writes the same ones. Of equal payloads of 100 bytes or more the one of the smallest key
    (numbers by value, then other keys, then none) is a response and the others are revisits of it; content without an HTTP head is a
    resource. Only digests are grouped; payloads are read again in a second pass and not shuffled
    unless the table of repeated digests outgrows Spark's broadcast threshold.
    """
    index = read_arc(spark, arc_path, with_body=False)
    order = F.struct(F.expr("try_cast(key AS bigint) IS NULL").alias("t"), F.expr("try_cast(key AS bigint)").alias("i"), F.col("key").isNull().alias("u"), "key", "file", "no", "url", "date")
    first = index.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("digest", *[F.col(f"f.{c}").alias(f"refers_{c}") for c in ("file", "no", "key", "url", "date")]), "first")
    rows = read_arc(spark, arc_path).join(first, "digest", "left")
    own = F.expr("refers_file = file AND refers_no = no")
    rows = rows.withColumn("refers_file", F.when(~own, F.col("refers_file")))
    _write(rows.mapInArrow(_warc_files(records), "value binary"), warc_path, ".warc.gz", records)


def warc_records(raw: bytes | memoryview) -> Iterator[tuple[dict, bytes]]:
    """(named fields in lower case, block) of each record of a plain or gzipped WARC file."""
    stream = _Stream(raw)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        head = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        block = stream.take(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("block ends early")
        yield head, block


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "record_type", "payload_bytes", "payload_digest", "refers_key", "record_id", "refers_id"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for raw in b.column(0):
            rows = []
            for head, block in warc_records(memoryview(raw.as_buffer())):
                if head["warc-type"] not in ("response", "revisit", "resource"):
                    continue
                http, body = _payload(block)
                repeat = head["warc-type"] == "revisit"
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if not repeat and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"payload differs from its digest: {head['warc-record-id']}")
                size = int(head["x-payload-length"]) if repeat else len(body)
                rows.append((_key(http), head["warc-type"], size, digest, head.get("x-refers-to-key") or None, head["warc-record-id"], head.get("warc-refers-to")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response, resource or revisit below ``path``; digests of responses are computed from the payload and checked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read_warc, "key string, record_type string, payload_bytes bigint, payload_digest string, refers_key string, record_id string, refers_id string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages to ARC files (the legacy input), those to WARC by the converter, and the WARC files read back.

    A null page_id comes back as null; repeated page_ids are records of their own.
    """
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    kind = dict(pages.dtypes)["page_id"]
    rows = read_warc(spark, warc)
    return rows.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast(kind).alias("refers_to"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": OP5_SQL}
