"""Web archives: ARC files of either version converted to WARC records, written through Spark and read back.

An ARC file holds a version block and records; each begins with a line of space-separated fields, whose last declares
the length of what follows. Version 1 lines end "... ip date type length"; version 2 lines end "... ip date type
result-code checksum location offset filename length".

WARC files are gzip members, one a record, and are written by Spark's text writer, which puts bytes down as they are:
there is no other way to a store that only Spark reaches, and its commit protocol survives lost executors. A row of the
writer is one file's bundle of members. The writer ends it with a zero byte, which is the last byte of every bundle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, bounded_broadcast, checkpointed, shared_folder, table

MIN_REVISIT_BYTES = 1000
#: Compressed bytes after which a WARC file is closed, and bytes of pages after which an ARC blob of the query is.
FILE_BYTES, ARC_BYTES = 16 << 20, 4 << 20
#: Duplicates are broadcast up to this many rows.
BROADCAST_REVISITS = 100_000
ARC_FIELDS = {1: 4, 2: 9}  # after the url
ARC_COLUMNS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "20240101000000"
_DATE = re.compile("[0-9]{14}")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    filename: str
    content: bytes


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_COLUMNS[version]}\n".encode()
    rest = f"0.0.0.0 {date} text/plain " + ("" if version == 1 else "200 - - 0 - ")
    return f"filedesc://{name} {rest}{len(body)}\n".encode() + body + b"\n"


def arc_url(url: str) -> str:
    """The url with its line ends as percent codes, which a header line can hold."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def arc_record(version: int, record: ArcRecord, offset: int = 0) -> bytes:
    url = arc_url(record.url)
    middle = "" if version == 1 else f"200 - - {offset} {record.filename} "
    return f"{url} {record.ip} {record.date} {record.mime} {middle}{len(record.content)}\n".encode() + record.content + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file of version 1 or 2, by declared lengths; urls may hold spaces.

    A line that is no header (too few fields, no date or no length) is passed over up to the next one that is, so a broken
    record costs itself alone. A cut-off record at the end is left out. A version block that doesn't tell its version
    leaves it to the number of its own fields.
    """
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc:")
        fields = line.rsplit(" ", ARC_FIELDS[(2 if len(line.split(" ")) >= 10 else 1) if first else version or 1])
        sized = len(fields) > 4 and fields[-1].isascii() and fields[-1].isdigit() and len(fields[-1]) < 16 and _DATE.fullmatch(fields[2])
        if not sized:
            at = end + 1
            continue
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            at = end + 1  # cut off, or a line that only looks like a header
            continue
        at = end + 1 + length
        if first:
            version = int(body[:1]) if body[:1] in (b"1", b"2") else len(fields) // 5
            continue
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], fields[-2] if version == 2 else "-", body)


def http_payload(content: bytes) -> bytes:
    """What follows the HTTP head; all of it where there is none."""
    if content.startswith(b"HTTP/"):
        return content.partition(b"\r\n\r\n")[2]
    return content


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(url: str, date: str, name: str, digest: str) -> str:
    """Depends on the record alone, so every run synthesises the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, name, digest)))}>"


@dataclass
class Original:
    """The record that a revisit refers to."""

    record_id: str
    url: str
    date: str


def to_warc(record: ArcRecord, original: Original | None = None, warcinfo: str | None = None) -> bytes:
    """A WARC record for an ARC record: a response (resource without HTTP head), or a revisit of ``original``. The name that
    version 2 gives a record is kept in an extension field."""
    payload = http_payload(record.content)
    digest = sha1(payload)
    block = record.content if original is None else record.content[: len(record.content) - len(payload)]
    http = record.content.startswith(b"HTTP/")
    head = {
        "WARC-Type": ("response" if http else "resource") if original is None else "revisit",
        "WARC-Record-ID": record_id(record.url, record.date, record.filename, digest),
        "WARC-Date": iso(record.date),
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip,
        "ARC-Filename": record.filename,
        "WARC-Block-Digest": sha1(block),
        "WARC-Payload-Digest": digest,
        "Content-Type": "application/http; msgtype=response" if http else record.mime,
    }
    if warcinfo is not None:
        head["WARC-Warcinfo-ID"] = warcinfo
    if original is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": original.record_id, "WARC-Refers-To-Target-URI": original.url, "WARC-Refers-To-Date": iso(original.date)}
    return warc_bytes(head, block)


def iso(d: str) -> str:
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_bytes(head: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return f"WARC/1.0\r\n{lines}".encode("utf-8", "replace") + block + b"\r\n\r\n"


def warcinfo(of: str) -> tuple[str, bytes]:
    """Id and bytes of the record that begins a file; ``of`` tells files apart."""
    name = record_id("", DATE, "", of)
    block = b"software: arc to warc converter\r\nformat: WARC File Format 1.0\r\n"
    return name, warc_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": name, "WARC-Date": iso(DATE), "Content-Type": "application/warc-fields"}, block)


def bundles(records: Iterable[tuple[ArcRecord, Original | None]], limit: int = FILE_BYTES) -> Iterator[bytes]:
    """Gzipped WARC files of about ``limit`` bytes at most, or of one longer record; each ends with a zero byte."""
    parts, size, about = [], 0, None
    for record, original in records:
        if not parts:
            about, info = warcinfo(f"{record.url} {record.filename} {sha1(record.content)}")
            parts, size = [gzip.compress(info, 4, mtime=0)], 0
        member = gzip.compress(to_warc(record, original, about), 4, mtime=0)
        parts.append(member)
        size += len(member)
        if size >= limit:
            yield ended(parts)
            parts = []
    if parts:
        yield ended(parts)


def ended(parts: list[bytes]) -> bytes:
    """Members joined; after one of 16 MB or more, whose length may end with another byte, an empty member stands last."""
    return b"".join(parts if parts[-1][-1] == 0 else [*parts, gzip.compress(b"", 4, mtime=0)])


def read_warc(data: bytes, gzipped: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record by declared lengths, decompressing as it goes."""
    buffer = bytearray()
    for chunk in _plain(data) if gzipped else [data]:
        buffer += chunk
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) >= 0:
            head = dict(line.split(": ", 1) for line in buffer[at:end].decode("utf-8").split("\r\n")[1:])
            stop = end + 4 + int(head["Content-Length"])
            if len(buffer) < stop + 4:
                break
            yield head, bytes(buffer[end + 4 : stop])
            at = stop + 4
        del buffer[:at]


def _plain(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Decompress gzip members one after another, a bounded piece of input at a time."""
    member = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        rest = data[at : at + step]
        while rest:
            yield member.decompress(rest)
            rest = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def page_arc(urls: list[str | None], names: list[str], bodies: list[bytes | None], version: int = 2) -> bytes:
    """An ARC file (whole, with version block) of pages."""
    parts = [arc_version_block(version, "pages", DATE)]
    size = len(parts[0])
    for url, name, body in zip(urls, names, bodies):
        body = body or b""
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        parts.append(arc_record(version, ArcRecord(url or "-", "0.0.0.0", DATE, "text/html", name, head + body), size))
        size += len(parts[-1])
    return b"".join(parts)


def revisit_plan(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(digest, response, response_url): for payloads of at least ``min_bytes`` that more than one row has, the row of the
    largest page_id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = pages.select("page_id", "url", F.sha1(payload).alias("digest"), F.length(payload).alias("bytes")).where(F.col("bytes") >= min_bytes)
    best = digests.groupBy("digest").agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("best"), F.count("*").alias("n"))
    return best.where("n > 1 AND best.page_id IS NOT NULL").select("digest", F.col("best.page_id").alias("response"), F.col("best.url").alias("response_url"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write a WARC record for each row (page_id, url, html) below ``path``, by way of ARC bytes.

    Of rows with equal payloads the one with the largest page_id is the response; a row repeated with the same page_id
    gives a response each time. Null ids are never referred to, and such rows revisit another's payload if there is one.
    """
    plan = bounded_broadcast(checkpointed(revisit_plan(pages.select("page_id", "url", "html"), min_bytes)), BROADCAST_REVISITS)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marked = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("digest")).join(plan, "digest", "left")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    marked = marked.select(F.concat(F.lit("page-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("name"), "url", "body", "digest", F.when(again, F.concat(F.lit("page-"), "response")).alias("original"), "response_url")

    def convert(batches):
        def records():
            for batch in batches:
                for part in arrow_slices(batch, "body", ARC_BYTES):
                    names, sources, places = part["name"].to_pylist(), part["original"].to_pylist(), part["response_url"].to_pylist()
                    digests = part["digest"].to_pylist()
                    # the row is part of the name on the way, so a lost record could not shift the others
                    arc = page_arc(part["url"].to_pylist(), [f"{n}#{k}" for k, n in enumerate(names)], part["body"].to_pylist())
                    for record in read_arc(arc):
                        name, _, row = record.filename.partition("#")
                        row, source = int(row), None
                        if sources[row] is not None:
                            url = arc_url(places[row] or "-")
                            source = Original(record_id(url, DATE, sources[row], base32(digests[row])), url, DATE)
                        yield replace(record, filename=name), source

        for bundle in bundles(records()):
            yield pa.RecordBatch.from_arrays([pa.array([bundle[:-1]], pa.binary())], ["value"])

    files = marked.mapInArrow(convert, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, name, record_type, payload_bytes, payload_digest hex, refers_id) of every WARC record below ``path`` but
    the files' own descriptions."""
    names = ["record_id", "name", "record_type", "payload_bytes", "payload_digest", "refers_id"]

    def parse(batches):
        for batch in batches:
            for data in batch["content"]:
                out = []
                for head, block in read_warc(data.as_buffer().to_pybytes(), True):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    revisit = head["WARC-Type"] == "revisit"
                    payload = http_payload(block)
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
                    out.append((head["WARC-Record-ID"], head["ARC-Filename"], head["WARC-Type"], None if revisit else len(payload), digest, head.get("WARC-Refers-To")))
                kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "record_id string, name string, record_type string, payload_bytes long, payload_digest string, refers_id string")


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives, read them back, and give each record's page_id, payload_bytes, payload_digest, record_type and
    refers_to. A revisit has the id and length of the response that it refers to. Null html is empty, null urls are "-",
    very long pages are files of their own. Columns of pages but page_id, url and html are not looked at, whatever their
    names. An empty table gives no rows."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc"
    write_warc(pages, path, min_bytes)
    page = F.when(F.length("name") > 5, F.substring("name", 6, 40)).cast("long")
    records = checkpointed(read_archives(spark, path)).withColumn("page_id", page)
    revisits = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_id")
    answers = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes")
    answers = answers.join(revisits.select("refers_id").distinct(), "refers_id", "left_semi").groupBy("refers_id").agg(F.max("refers_to").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    single = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return single.select(*names).unionByName(revisits.join(answers, "refers_id", "left").select(*names))


def convert_arcs(spark: SparkSession, source: str, path: str) -> None:
    """Convert the ARC files (gzipped or not) below ``source`` to WARC files below ``path``."""

    def convert(batches):
        for batch in batches:
            for data in batch["content"]:
                data = data.as_buffer().to_pybytes()
                plain = b"".join(_plain(data)) if data[:2] == b"\x1f\x8b" else data
                for bundle in bundles((record, None) for record in read_arc(plain)):
                    yield pa.RecordBatch.from_arrays([pa.array([bundle[:-1]], pa.binary())], ["value"])

    files = spark.read.format("binaryFile").load(source).select("content").mapInArrow(convert, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), d AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN d USING (payload_digest)
"""
