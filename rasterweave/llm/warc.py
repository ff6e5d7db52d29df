"""Converter from legacy ARC archives to WARC, with payload revisits.

ARC version 1 has five header fields a record (URL, IP, date, type, length), version 2
ten (URL, IP, date, type, result, checksum, location, offset, file, length). A file opens with a
``filedesc://`` record that names its version. Content is taken by the declared
length. Converted records get identifiers derived from their archive and place in it (the
same after a retry), ISO timestamps, a WARC type by what the content is, and SHA-1 digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_folder, materialise, prepare, scratch, sized_join

#: Fields of a header line by the file's major version.
FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length")}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SPACE = uuid.UUID("8b4a3b60-52c5-5b34-9f0e-0d5a8c1f7e21")
PAGE = b"X-Page-Id: "


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    truncated: bool


def build_arc(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, ip, date, mime, content) records."""

    def line(url, ip, date, mime, n):
        url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) or "-"
        extra = "" if version == 1 else f" 200 - - 0 {name}"
        return f"{url} {ip} {date} {mime}{extra} {n}\n".encode()

    about = f"{version} 0 converter\n".encode() + b"URL IP-address Archive-date Content-type " + (b"" if version == 1 else b"Result-code Checksum Location Offset Filename ") + b"Archive-length\n"
    parts = [line(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", len(about)), about, b"\n"]
    for url, ip, date, mime, content in records:
        parts += [line(url, ip, date, mime, len(content)), content, b"\n"]
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block; empty data has none.

    A header with another number of fields than the version's, or a length that is no number,
    raises ValueError; a last record shorter than declared is marked truncated.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        fields = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        first = version is None
        if first:
            if not fields[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with a filedesc record")
        elif len(fields) != len(FIELDS[version]):
            raise ValueError(f"{len(fields)} fields in an ARC {version} header")
        try:
            length = int(fields[-1])
        except ValueError as e:
            raise ValueError("an ARC header's last field is a length") from e
        content = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if first:
            version = 2 if content[:1] == b"2" else 1
            if len(fields) != len(FIELDS[version]):
                raise ValueError(f"{len(fields)} fields in an ARC {version} version block")
            continue
        named = dict(zip(FIELDS[version], fields))
        yield ArcRecord(named["url"], named["ip"], named["date"], named["mime"], content, len(content) < length)


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """(status line and headers, payload) of an HTTP response, else None."""
    if not content.startswith(b"HTTP/"):
        return None
    at = content.find(b"\r\n\r\n")
    if at >= 0:
        return content[: at + 4], content[at + 4 :]
    at = content.find(b"\n\n")
    return (content[: at + 2], content[at + 2 :]) if at >= 0 else (content, b"")


def iso_date(date: str) -> str:
    """14-digit ARC dates (shorter ones are padded) as WARC timestamps."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(path: str, place: int) -> str:
    """The same for the same record of the same archive, so a retry or another reading keeps it."""
    return f"urn:uuid:{uuid.uuid5(SPACE, f'{path}|{place}')}"


def page_of(headers: bytes) -> int | None:
    at = headers.find(PAGE)
    value = headers[at + len(PAGE) : headers.find(b"\r\n", at)] if at >= 0 else b""
    return int(value) if value else None


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one WARC record."""
    sha = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n", 1, mtime=0)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-cased name, block) of each record of a .warc.gz."""
    at = 0
    while at < len(data):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            step = data[at : at + 65536]
            if not step:
                raise ValueError("the archive ends within a record")
            out.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        raw = b"".join(out)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        yield fields, rest[: int(fields["content-length"])]


def arcs_of_pages(pages: DataFrame, date: str = "20000101000000", arc_bytes: int = 2_000_000) -> DataFrame:
    """(path, content): ARC files of the pages, version 1 and 2 by turns. Null html is an
    empty payload, a null url ``-``; other columns are not read; no pages give no files."""
    prepare(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, files = TaskContext.get().partitionId(), 0

        def arc(some):
            nonlocal files
            files += 1
            return pd.DataFrame({"path": [f"pages-{part:06d}-{files:05d}.arc"], "content": [build_arc(some, 2 - files % 2)]})

        for batch in batches:
            some, size = [], 0
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                payload = b"" if html is None else html.encode()
                mark = b"" if pd.isna(page) else PAGE + str(int(page)).encode() + b"\r\n"
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"Content-Length: %d\r\n\r\n" % len(payload)
                some.append((url or "", "0.0.0.0", date, "text/html", http + payload))
                size += len(payload)
                if size >= arc_bytes:
                    yield arc(some)
                    some, size = [], 0
            if some:
                yield arc(some)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "path string, content binary")


def arc_records(arcs: DataFrame, content: bool = True) -> DataFrame:
    """Parsed records: path and place of the record in it, page_id, url, ip, date, mime, payload_bytes, digest (hex) and,
    if asked for, headers, payload and whether it was truncated."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows = []
                for place, r in enumerate(parse_arc(data)):
                    headers, payload = split_http(r.content) or (b"", r.content)
                    row = (path, place, page_of(headers), r.url, r.ip, r.date, r.mime, len(payload), hashlib.sha1(payload).hexdigest())
                    rows.append(row + (headers, payload, r.truncated) if content else row)
                if rows:
                    out = pd.DataFrame(rows, columns=names)
                    out["page_id"] = out["page_id"].astype("Int64")
                    yield out

    schema = "path string, place int, page_id long, url string, ip string, date string, mime string, payload_bytes long, digest string" + (", headers binary, payload binary, truncated boolean" if content else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return arcs.select("path", "content").mapInPandas(run, schema)


def convert(arcs: DataFrame, folder: str, least: int = 1000, file_bytes: int = 16_000_000) -> DataFrame:
    """Write the records of ``arcs`` (path, content; paths differ) as .warc.gz files below ``folder``;
    returns (file, records) of what was written.

    Of HTTP or other records with equal payloads of at least ``least`` bytes, the one
    with the largest page_id is written whole, the others as revisits of it; of repeated rows of that
    page one is. A null id counts as the smallest, and where all are null all are written whole. Every record has its own
    identifier. No archives give no files. Content that is no HTTP response becomes a resource record.
    Executors write with pyarrow to a URI all share; a task run again moves the same file into place.
    """
    prepare(arcs.sparkSession)
    make_folder(arcs.sparkSession, folder)
    marks = arc_records(arcs, content=False).where(f"payload_bytes >= {least} and page_id is not null")
    first = F.max(F.struct("page_id", "url", "date", "path", "place"))
    copied = marks.groupBy("digest").agg(first.alias("of"), F.count("*").alias("n")).where("n > 1").select("digest", "of")
    copied = materialise(copied, "copied-payloads")
    records = sized_join(arc_records(arcs), copied, "digest", "left")
    itself = (F.col("path") == F.col("of.path")) & (F.col("place") == F.col("of.place"))
    again = (F.col("payload_bytes") >= least) & F.col("of").isNotNull() & ~F.coalesce(itself, F.lit(False))
    records = records.select("path", "place", "url", "ip", "date", "mime", "digest", "headers", "payload", "truncated", again.alias("again"), F.col("of.path").alias("of_path"), F.col("of.place").alias("of_place"), F.col("of.url").alias("of_url"), F.col("of.date").alias("of_date"))

    def write(batches):
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        parts, size, count, files = [], 0, 0, 0

        def flush():
            nonlocal parts, size, count, files
            name = f"pages-{context.partitionId():06d}-{files:05d}.warc.gz"
            info = warc_record("warcinfo", [("WARC-Record-ID", f"<{record_id(name, -1)}>"), ("WARC-Date", iso_date("")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: ARC converter\r\nformat: WARC File Format 1.0\r\n")
            partial = f"{root}/_{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(partial, compression=None) as out:
                out.write(info)
                out.write(b"".join(parts))
            fs.move(partial, f"{root}/{name}")
            done = pd.DataFrame({"file": [name], "records": [count]})
            parts, size, count, files = [], 0, 0, files + 1
            return done

        for batch in batches:
            for r in batch.itertuples(index=False):
                fields = [("WARC-Record-ID", f"<{record_id(r.path, r.place)}>"), ("WARC-Date", iso_date(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r.digest)).decode())]
                if r.truncated:
                    fields.append(("WARC-Truncated", "unspecified"))
                if not r.headers:
                    kind, block = "resource", r.payload
                    fields.append(("Content-Type", r.mime))
                else:
                    kind, block = "response", r.headers + r.payload
                    fields.append(("Content-Type", "application/http;msgtype=response"))
                if r.again:
                    kind, block = "revisit", r.headers
                    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{record_id(r.of_path, int(r.of_place))}>"), ("WARC-Refers-To-Target-URI", r.of_url), ("WARC-Refers-To-Date", iso_date(r.of_date))]
                parts.append(warc_record(kind, fields, block))
                size, count = size + len(parts[-1]), count + 1
                if size >= file_bytes:
                    yield flush()
        if parts:
            yield flush()

    return materialise(records.mapInPandas(write, "file string, records long"), "warc-manifest")


def read_warcs(spark, folder: str) -> DataFrame:
    """(page_id, record_id, payload_bytes, payload_digest, record_type, refers_to_id)
    of every content record in the archives below ``folder``.

    Responses' figures come from their payloads; a revisit's digest is the one it
    carries and its length its HTTP Content-Length.
    """
    prepare(spark)

    def run(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for fields, block in parse_warc(data):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    headers, payload = split_http(block) or (b"", block)
                    digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    if kind == "revisit":
                        digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                        n = int(headers.partition(b"Content-Length: ")[2].partition(b"\r\n")[0])
                    rows.append((page_of(headers), fields["warc-record-id"], n, digest, kind, fields.get("warc-refers-to")))
                out = pd.DataFrame(rows, columns=["page_id", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"])
                out["page_id"] = out["page_id"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(folder).select("content")
    return files.mapInPandas(run, "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to_id string")


def op7_warc_conversion(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch(spark, "warc")
    convert(materialise(arcs_of_pages(pages), "arcs"), folder)
    rows = materialise(read_warcs(spark, folder), "warc-rows")
    named = rows.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"))
    plain = rows.where("refers_to_id is null").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.where("refers_to_id is not null").join(named.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    return plain.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest
"""
