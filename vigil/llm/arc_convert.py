"""Legacy archives (ARC, versions 1 and 2) and their conversion to WARC.

``write_arc`` puts pages into ARC files as HTTP responses. ``convert`` reads ARC files: a version block (``filedesc``)
names the layout of the header lines after it, five fields in version 1 and ten in version 2, and each header declares
the length of what follows. From these it makes WARC records: an identifier from the archive's path and the record's
offset (names inside archives may repeat, paths can't), a timestamp, the type, and SHA-1 digests. Of records with equal payloads (by SHA-256 and length) of at least a
given size, that with the smallest page id is the response; others become revisits that refer to it. ``read_warc``
reads WARC files back and verifies lengths and digests.

Files are written and read by Spark, so any store that Spark knows will do. A row of the text writer holds a few
records that end as the format wants (a line feed for ARC, two CR LF for WARC, which the writer's line separator adds);
rows are closed at ``SEGMENT`` bytes and files after ``PER_FILE`` rows, so neither grows with the input.

Scale: an archive is decompressed as it is parsed, a record at a time, in a narrow pass over the files: once for ids and
digests, and once for the records, which then meet what was decided for them by their ids. Spark broadcasts the decisions
if their measured size allows it, and else shuffles both by id, so a task's share follows from the number of records.

Defined results: a null html is an empty payload; a null url is written as ``about:blank``; white space, control and
other characters that a header line can't hold are percent-encoded; a null page id comes after all others and is read
back as null; rows that repeat are records of their own, of which one is the response; extra columns are left out; an
empty table gives an empty result. Archives of one inner name and whole archives that repeat are records of their own
too. An archive that ends within a record or within its compression raises an error, and so does a file of 2 GB or more
(as stored), which Spark's reader of whole files can't take.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.plans import scratch
from vigil.plans.shipping import ship

SEGMENT, PER_FILE = 4 << 20, 4
#: Compressed bytes handed on at a time.
READ = 1 << 16
CAPTURED = "20240101000000"
#: The field names of the two versions' header lines, and the profile of a revisit.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe_url(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,-./:;=?@[]_~") if url else "about:blank"


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def _arc_header(version: int, url: str, kind: str, body: bytes, code: str, name: str, offset: int) -> bytes:
    first = f"{url} 0.0.0.0 {CAPTURED} {kind}"
    more = f" {code} {sha1_base32(body)} - {offset} {name}" if version == 2 else ""
    return f"{first}{more} {len(body)}\n".encode()


def _segments(pages: Iterator[tuple], version: int, name: str) -> Iterator[bytes]:
    """Self-contained stretches of an ARC file: a version block and records, without the last line feed."""
    parts, size, number = [], 0, 0
    for page_id, url, html in pages:
        if not parts:
            own = f"{name}-{number}.arc"
            about = f"{version} 0 vigil\n{FIELDS[version]}\n".encode()
            parts = [_arc_header(version, f"filedesc://{own}", "text/plain", about, "200", own, 0) + about]
            size, number = len(parts[0]), number + 1
        body = _http(page_id, (html or "").encode())
        parts.append(_arc_header(version, _safe_url(url), "text/html", body, "200", own, size) + body)
        size += len(parts[-1]) + 1
        if size >= SEGMENT:
            yield b"\n".join(parts)
            parts = []
    if parts:
        yield b"\n".join(parts)


def _write(rows: DataFrame, path: str, end: str) -> None:
    """Write binary rows as they are, each followed by ``end``."""
    writer = rows.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    with scratch.cleaned(rows.sparkSession):
        writer.option("maxRecordsPerFile", PER_FILE).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """Write (page_id, url, html) as ARC files; partitions take version 1 and 2 in turn."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        for segment in _segments(rows, 1 + part % 2, f"pages-{part:05d}"):
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], ["value"])

    _write(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "value binary"), path, "\n")


class _Source:
    """Bytes read in order; gzip members, of which there may be many, are decompressed as they are needed."""

    def __init__(self, data: bytes):
        self.parts, self.buffer, self.at, self.passed = self._plain(data), b"", 0, 0

    @staticmethod
    def _plain(data: bytes) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        at, member = 0, zlib.decompressobj(31)
        while at < len(data):
            piece = data[at : at + READ]
            at += len(piece)
            yield member.decompress(piece)
            if member.eof:
                at -= len(member.unused_data)
                if at < len(data):
                    member = zlib.decompressobj(31)
        if not member.eof:
            raise ValueError("the archive ends within its compression")

    def _more(self) -> bool:
        for part in self.parts:
            if part:
                self.buffer, self.passed, self.at = self.buffer[self.at :] + part, self.passed + self.at, 0
                return True
        return False

    @property
    def place(self) -> int:
        return self.passed + self.at

    def until(self, end: bytes) -> bytes | None:
        """What comes before ``end``, and past it; None where nothing is left."""
        while (found := self.buffer.find(end, self.at)) < 0:
            if not self._more():
                if self.at == len(self.buffer):
                    return None
                raise ValueError(f"the archive ends within a header: {self.buffer[self.at :][:80]!r}")
        out = self.buffer[self.at : found]
        self.at = found + len(end)
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        parts, left = [], n
        while left:
            own = self.buffer[self.at : self.at + left]
            self.at += len(own)
            left -= len(own)
            parts.append(own)
            if left and not self._more():
                break
        return b"".join(parts)


def arc_records(data: bytes, path: str = "") -> Iterator[dict]:
    """The records of an ARC file, compressed or not, by the declared lengths. Their ids follow from ``path`` and their
    offset in the decompressed file."""
    source, version, name = _Source(data), 0, ""
    while True:
        at = source.place
        line = source.until(b"\n")
        if line is None:
            return
        if not line:  # the line feed between records
            continue
        line = line.decode()
        if line.startswith("filedesc://"):
            about = source.take(int(line.rsplit(" ", 1)[1]))
            version, name = int(about.split(b" ", 1)[0]), line.split(" ", 1)[0][11:]
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        if version not in FIELDS:
            raise ValueError(f"a record comes before any version block: {line[:200]!r}")
        names = FIELDS[version].split()
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"not a header line of ARC version {version}: {line[:200]!r}")
        out = dict(zip(names, values, strict=True))
        body = source.take(int(out["Archive-length"]))
        if len(body) != int(out["Archive-length"]):
            raise ValueError(f"the archive ends within {out['URL']}")
        head, _, payload = body.partition(b"\r\n\r\n")
        found = re.search(rb"(?mi)^X-Page-Id:\s*(-?\d+)\s*$", head)
        yield out | {"id": f"<urn:uuid:{uuid.uuid5(_SPACE, f'{path}#{at}')}>", "archive": name, "head": head, "payload": payload, "page_id": int(found[1]) if found else None}


def _warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record without the two CR LF at its end."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", len(block))]]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def _warc_record(r: dict) -> bytes:
    """The WARC record of a row of ``_RECORD``; first_id, if any, is the response that a revisit refers to."""
    again, head = r["first_id"] is not None, r["head"] + b"\r\n\r\n"
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", r["id"]), ("WARC-Date", _warc_date(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("X-Converted-From", r["archive"])]
    if again:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", r["first_id"])] + ([("X-Refers-To-Page", r["first_page"])] if r["first_page"] is not None else [])
    fields += [("WARC-Payload-Digest", f"sha1:{sha1_base32(r['payload'])}"), ("Content-Type", "application/http; msgtype=response")]
    return _warc(fields, head if again else head + r["payload"])


_RECORD = {"id": "id", "archive": "archive", "url": "URL", "ip": "IP-address", "date": "Archive-date", "head": "head", "payload": "payload"}


def _parsed(files: DataFrame, names: dict[str, str], schema: str, kinds: tuple) -> DataFrame:
    """Fields of all records of archives, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], list(names))
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for r in arc_records(data.as_py(), path.as_py()):
                    if "sha" in names:
                        r |= {"sha": hashlib.sha256(r["payload"]).digest(), "size": len(r["payload"])}
                    rows.append([r[c] for c in names.values()])
                    size += 200 + (len(r["payload"]) if "payload" in names else 0)
                    if size >= SEGMENT:
                        yield own(rows)
                        rows, size = [], 0
                if rows:
                    yield own(rows)

    return files.mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Convert all ARC files below ``arc_path`` to WARC files below ``warc_path``."""
    ship(spark)
    files = spark.read.format("binaryFile").load(arc_path).select("path", "content")
    found = _parsed(files, {c: c for c in ("id", "page_id", "sha", "size")}, "id string, page_id long, sha binary, size long", (pa.string(), pa.int64(), pa.binary(), pa.int64()))
    found = scratch.table(found)
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "id")
    firsts = scratch.table(found.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    again = found.join(firsts, ["sha", "size"]).filter(F.col("id") != F.col("first.id"))
    again = scratch.table(again.select("id", F.col("first.id").alias("first_id"), F.col("first.page_id").alias("first_page")))
    scratch.drop(found, firsts)
    records = _parsed(files, _RECORD, "id string, archive string, url string, ip string, date string, head binary, payload binary", (*[pa.string()] * 5, pa.binary(), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        own = lambda: pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(parts)], pa.binary())], ["value"])
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                r = dict(zip(batch.schema.names, values, strict=True))
                if not parts:
                    about = b"software: vigil\r\nformat: WARC File Format 1.1\r\n"
                    parts = [_warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, 'info ' + r['id'])}>"), ("WARC-Date", _warc_date(r["date"])), ("Content-Type", "application/warc-fields")], about)]
                parts.append(_warc_record(r))
                size += len(parts[-1])
                if size >= SEGMENT:
                    yield own()
                    parts, size = [], 0
        if parts:
            yield own()

    _write(records.join(again, "id", "left").mapInArrow(run, "value binary"), warc_path, "\r\n\r\n")
    scratch.drop(again)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, compressed or not, by the declared lengths; digests are
    verified."""
    source = _Source(data)
    while True:
        at, head = source.place, source.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}: {lines[0][:80]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = source.take(int(fields["Content-Length"]))
        if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"the block of {fields['WARC-Record-ID']} doesn't have its digest")
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"{fields['WARC-Record-ID']} is longer than its declared length")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url,
    date. Sizes and digests are those of the full payload, which a revisit's HTTP head and header declare."""
    ship(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]

    def row(f: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        page, size = (re.search(rb"(?mi)^" + k + rb":\s*(-?\d+)\s*$", head) for k in (b"X-Page-Id", b"Content-Length"))
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and (len(payload) != int(size[1]) or sha1_base32(payload) != digest):
            raise ValueError(f"the payload of {f['WARC-Record-ID']} is not the declared one")
        to = f.get("X-Refers-To-Page")
        return int(page[1]) if page else None, int(size[1]), digest, f["WARC-Type"], int(to) if to else None, f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for data in batch.column(0):
                rows = [row(*r) for r in warc_records(data.as_py()) if r[0]["WARC-Type"] in ("response", "revisit")]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back; the WARC files stay in the shared folder while they are
    read (see ``scratch``)."""
    spark = pages.sparkSession
    arc, warc = scratch.folder(spark), scratch.folder(spark)
    for path in (arc, warc):
        scratch.track(spark, path)
    write_arc(pages, arc)
    convert(spark, arc, warc, min_bytes)
    scratch.delete(arc)
    return read_warc(spark, warc)
