"""Legacy archive converter: ARC version 1 and 2 archives become WARC/1.0 archives.

``parse_arc`` reads an ARC archive by its version block, header lines and declared lengths; ``convert`` reads the ARC archives of a folder and
synthesises WARC records with identifiers, timestamps, types and digests: ``response`` for blocks that start with an HTTP status line (headers and body
are told apart; the payload is the body), ``resource`` for others (``dns:`` and the like), ``revisit`` for payloads that another record has, and a
``warcinfo`` from each archive's version block. ``write_arc`` leaves a table of pages as such archives, and ``read_warc`` reads WARC archives back by their declared lengths.

Archives are files of one gzip member a record, of up to ``ARCHIVE_BYTES`` and one record; Spark's text writer writes an archive as one row, and an empty gzip member is its row separator.
Which records are revisits is found from digests, lengths and places alone; only the archives' compressed bytes are joined with it, by path; where revisits are few enough they are broadcast to the archives instead.

Defined results: a null html is an empty payload; a null url becomes the URI ``unknown:``; rows with equal
payloads of at least ``min_revisit`` bytes revisit the smallest page_id among them; rows that repeat this
page_id as well are responses too, with record ids of their own; a null page_id sorts after all others. Very long payloads are in archives of their own. An empty table gives no archive rows.
Columns besides page_id, url and html are ignored. In foreign archives a URL may hold blanks and a result code may be ``-``; lines where no record starts are passed over up to the next
header line, and a record that is cut off by the end of its archive is left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import discard, held, join_counted, materialize, shared_path

# Fixed values of the ARC and WARC formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ARC_MINOR = {1: "1 0", 2: "2 0"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
END = b"\r\n\r\n"
ARC_DATE = re.compile(r"\d{4,14}|-")

ARCHIVE_BYTES, BROADCAST_REVISITS = 8 << 20, 100_000
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
FIELDS = "page_id bigint, uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string"
PLACES = "path string, place bigint, page_id bigint, digest string, n bigint"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    status: int | None
    block: bytes

    def parts(self) -> tuple[bytes, bytes]:
        """HTTP header (empty if there is none) and payload."""
        if not self.block.startswith(b"HTTP/"):
            return b"", self.block
        ends = [(at, at + len(e)) for e in (END, b"\n\n") if (at := self.block.find(e)) >= 0]
        return (self.block[: min(ends)[1]], self.block[min(ends)[1] :]) if ends else (self.block, b"")

    def http_header(self, name: str) -> str | None:
        return http_field(self.parts()[0], name)


def http_field(header: bytes, name: str) -> str | None:
    for line in header.decode("latin-1").splitlines():
        k, _, v = line.partition(":")
        if k.lower() == name.lower():
            return v.strip()
    return None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The contents of a file's gzip members; what follows the last one is no member and left out. A member is fed in small steps, so what it leaves over is small."""
    at = 0
    while data.startswith(b"\x1f\x8b", at):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            part = data[at : at + step]
            if not part:
                raise ValueError("a gzip member is cut off")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def unpack(data: bytes) -> bytes:
    return b"".join(members(data)) if data.startswith(b"\x1f\x8b") else data


def arc_url(url: str | None) -> str:
    """A URL as one field of an ARC line: white space and controls are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "unknown:"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    """What a crawler keeps of a page: status line, headers and body."""
    own = f"X-Page-ID: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def build_arc(records: Iterable[tuple[str | None, bytes]], version: int, date: str = "20200101000000", name: str = "pages.arc", mime: str = "text/html") -> list[bytes]:
    """The version block and the records of an ARC archive of (url, block), as a legacy crawler would have left it."""
    about = f"{ARC_MINOR[version]} meshlark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain".encode() + (b"" if version == 1 else b" 200 - - 0 " + name.encode()) + f" {len(about)}\n".encode() + about + b"\n"]
    at = len(out[0])
    for url, block in records:
        head = f"{arc_url(url)} 0.0.0.0 {date} {mime}"
        head += f" {len(block)}\n" if version == 1 else f" 200 - - {at} {name} {len(block)}\n"
        out.append(head.encode() + block + b"\n")
        at += len(out[-1])
    return out


def _header(line: bytes, fields: tuple[str, ...] | None) -> dict[str, str] | None:
    """The fields of a header line, or None if it is none; blanks that are too many belong to the URL."""
    for names in [fields] if fields else (ARC_FIELDS[2], ARC_FIELDS[1]):
        parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(parts) == len(names) and parts[-1].isdigit() and ARC_DATE.fullmatch(parts[2]) and parts[0]:
            return dict(zip(names, parts, strict=True))
    return None


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive, its version block (a ``filedesc:`` record) among them. That block says which header fields the lines have."""
    at, fields = 0, None
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        head = _header(data[at:stop].rstrip(b"\r"), fields)
        if head is None:
            at = stop + 1
            continue
        at = stop + 1 + int(head["Archive-length"])
        if at > len(data):  # cut off, or no length: the next line may start a record
            at = stop + 1
            continue
        block = data[stop + 1 : at]
        if head["URL"].startswith("filedesc:"):
            version = block[:1]
            fields = ARC_FIELDS[int(version)] if version in (b"1", b"2") else fields
        code = head.get("Result-code", "")
        yield ArcRecord(head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], int(code) if code.isdigit() else None, block)


def record_id(path: str, place: int) -> str:
    """Each place in an archive has an identifier of its own, the same each time."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{path}#{place}')}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date if arc_date.isdigit() else "19700101").ljust(14, "0")
    d = d[:4] + (d[4:6] if d[4:6] != "00" else "01") + (d[6:8] if d[6:8] != "00" else "01") + d[8:]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, own_id: str, revisits: tuple[str, int | None] | None = None) -> bytes:
    """The WARC record equivalent to an ARC record, with the CRLF CRLF that ends it. ``revisits``: record id and page id of the response with the same payload; such a record keeps
    its HTTP header, and has the payload's digest alone."""
    header, payload = record.parts()
    kind = "warcinfo" if record.url.startswith("filedesc:") else "revisit" if revisits else "response" if header else "resource"
    block = header if revisits else record.block
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {warc_date(record.date)}"]
    if kind == "warcinfo":
        block = f"software: meshlark\r\nformat: WARC File Format 1.0\r\nconverted-from: {record.url}\r\n".encode()
        head.append("Content-Type: application/warc-fields")
    else:
        head += [f"WARC-Target-URI: {record.url}", f"WARC-IP-Address: {record.ip}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
        head.append("Content-Type: application/http; msgtype=response" if header else f"Content-Type: {record.mime}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {revisits[0]}", *([f"X-Refers-To-Page-ID: {revisits[1]}"] if revisits[1] is not None else []), f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (header, block) pairs of a WARC archive, by declared lengths."""
    at = 0
    while at < len(data):
        if (stop := data.find(END, at)) < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        body = stop + 4
        at = body + int(head["content-length"])
        if data[at : at + 4] != END:
            raise ValueError("a WARC record does not end where its declared length says")
        yield head, data[body:at]
        at += 4


def _save(archives: DataFrame, path: str) -> None:
    """One file a row of ``archives`` (value: the bytes of a file)."""
    separator = EMPTY_MEMBER.decode("latin-1")
    with held(archives.sparkSession):
        archives.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _arcs(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, k = [], 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(map(member, build_arc(held, 1 + k % 2)))], pa.binary())], ["value"])

        for b in batches:
            for i, u, t in zip(*(b.column(j) for j in range(3)), strict=True):
                held.append((u.as_py(), http_block(i.as_py(), (t.as_py() or "").encode())))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield close()
                    held, size, k = [], 0, k + 1
        if held:
            yield close()

    return run


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Leave pages as ARC archives below ``path``, versions 1 and 2 by turns."""
    _save(pages.select("page_id", "url", "html").mapInArrow(_arcs(archive_bytes), "value binary"), path)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = []
            for k, r in enumerate(parse_arc(unpack(content.as_py()))):
                if not r.url.startswith("filedesc:"):
                    header, payload = r.parts()
                    own = http_field(header, "X-Page-ID")
                    rows.append((path, k, int(own) if own else None, base32_sha1(payload), len(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], [f.split()[0] for f in PLACES.split(", ")])


def _warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content, again in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            refers = {x["place"]: (record_id(x["path"], x["first"]), x["id"]) for x in again.as_py() or []}
            out = b"".join(member(to_warc(r, record_id(path, k), refers.get(k))) for k, r in enumerate(parse_arc(unpack(content.as_py()))))
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = 0) -> None:
    """The ARC archives below ``arc_path`` as WARC archives below ``warc_path``."""
    places = materialize(_files(spark, arc_path).mapInArrow(_places, PLACES), "places", True)
    at = F.struct(F.col("page_id").alias("id"), "path", F.col("place").alias("first"))
    first = places.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), at)).alias("known"), F.min(at).alias("any"), F.count(F.lit(1)).alias("count")).where("count > 1")
    first = first.select("digest", "count", F.coalesce("known", "any").alias("r"))
    again = materialize(join_counted(places.where(F.col("n") >= min_revisit), first, ["digest"], places.count()).where(~F.col("page_id").eqNullSafe(F.col("r.id"))), "revisits", True)
    by_file = again.groupBy("path").agg(F.collect_list(F.struct("place", F.col("r.id").alias("id"), F.col("r.path").alias("path"), F.col("r.first").alias("first"))).alias("again"))
    if again.count() <= BROADCAST_REVISITS:  # rows of two short paths and three numbers: some 30 MB at most; the archives then stay where they are
        by_file = F.broadcast(by_file)
    _save(_files(spark, arc_path).join(by_file, "path", "left").mapInArrow(_warcs, "value binary"), warc_path)
    discard(places, again)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in FIELDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for content in b.column(1):
            rows = []
            for data in members(content.as_py()):
                for head, block in parse_warc(data):
                    if (kind := head["warc-type"]) == "warcinfo":
                        continue
                    r = ArcRecord(head["warc-target-uri"], "", "", "", None, block)
                    header, payload = r.parts()
                    digest, own = head["warc-payload-digest"].removeprefix("sha1:"), http_field(header, "X-Page-ID")
                    if kind != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
                    number = lambda k: int(head[k]) if k in head else None
                    rows.append((int(own) if own else None, head["warc-target-uri"], number("x-payload-length") if kind == "revisit" else len(payload), digest, kind, number("x-refers-to-page-id"), head["warc-record-id"]))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, but for ``warcinfo``, of the archives below ``path``."""
    return _files(spark, path).mapInArrow(_read, FIELDS)


def op6_warc(spark: SparkSession, pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    write_arc(pages, arcs := shared_path(spark, "arc"))
    convert(spark, arcs, path := shared_path(spark, "warc"), min_revisit)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(position(substr(hex, i, 1) IN '0123456789abcdef') - 1), 4, '0')), 'string_agg', '') AS bits FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(5 * i + j AS BIGINT), 1) AS BIGINT) * CAST(2 ** (5 - j) AS BIGINT))) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
