"""Legacy ARC archives and their conversion to WARC, through Spark's own readers and writers.

An archive is a run of gzip members, one a record, so a record can be read or moved alone. Tasks put records together up
to a bound in bytes and Spark's text writer puts each such row in a file of its own; the zero byte that it writes after a
row is padding that gzip readers skip. Archives are read back with the binaryFile source. So any store that Spark can
reach will do, and a lost task is simply run again.
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

from reconspark.llm.common import Scratch

ARCHIVE_BYTES = 16 << 20
#: Fields of a record's header line by version of the ARC format. Fixed values of that format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:reconspark:arc")


def squeeze(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, the member as stored, its content) of each gzip member; zero padding is skipped."""
    at, view, step = 0, memoryview(data), 1 << 15
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        d, out, end = zlib.decompressobj(31), [], at
        while not d.eof:
            if end >= len(view):
                raise ValueError(f"gzip member at {at} is cut short")
            out.append(d.decompress(view[end : end + step]))
            end = min(end + step, len(view))
        end -= len(d.unused_data)
        yield at, bytes(view[at:end]), b"".join(out)
        at = end


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 reconspark\n{ARC_TITLES[version]}\n"
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "mime": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return (" ".join(fields[k] for k in ARC_FIELDS[version]) + "\n" + body + "\n").encode()


def arc_record(version: int, name: str, url: str | None, date: str, page_id: int | None, payload: bytes) -> bytes:
    """A header line and an HTTP response of the declared length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = {"url": quote(url or "about:blank", safe="/:?#[]@!$&'()*+,;=%~-._"), "ip": "0.0.0.0", "date": date, "mime": "text/html", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(block))}
    return " ".join(fields[k] for k in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes, version: int) -> dict:
    """The header fields of one record by version, and the block of the declared length."""
    line, _, rest = data.partition(b"\n")
    names = ARC_FIELDS[version]
    values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)  # only an address can hold spaces
    if len(values) != len(names) or not values[-1].isdigit() or len(rest) < int(values[-1]):
        raise ValueError(f"no record of ARC version {version}: {line[:200]!r}")
    out = dict(zip(names, values, strict=True))
    return out | {"block": rest[: int(out["length"])]}


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, head, payload) of an HTTP response; without one the whole block is the payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return fields, head + gap, payload


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_sha1: str, place: str) -> str:
    """The same for the same record on every run, and known to a revisit from its original's id and digest alone."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {payload_sha1}' if page_id is not None else place)}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if not re.fullmatch(r"WARC/1\.\d", first) or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"no WARC record: {head[:200]!r}")
    return fields, rest[:length]


def convert(arc: dict, page_id: int | None, original: int | None, place: str) -> bytes:
    """The WARC record of an ARC record: identifier, timestamp, type and digests are synthesised; original: what a revisit repeats."""
    _, head, payload = http_parts(arc["block"])
    sha1, d = hashlib.sha1(payload).hexdigest(), arc["date"].ljust(14, "0")
    block = arc["block"] if original is None else head
    fields = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, sha1, place)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", arc["url"]),
        ("WARC-IP-Address", arc["ip"]),
        ("WARC-Payload-Digest", sha1_base32(payload)),
        ("WARC-Block-Digest", sha1_base32(block)),
        ("Content-Type", "application/http; msgtype=response" if head else arc["mime"]),
    ]
    if original is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(original, sha1, "")), ("X-Refers-To-Page-Id", str(original))]
    return warc_record(fields, block)


def _write(archives: DataFrame, path: str) -> None:
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _batch(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary())], names=["value"])


def write_arc(pages: DataFrame, path: str, date: str = "20260101000000") -> None:
    """pages(page_id, url, html) as ARC archives, of version 1 and 2 in turn. Null html: an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, size, made = [], 0, 0
        for b in batches:
            for page_id, url, html in zip(*(b.column(i) for i in range(3)), strict=True):
                version = 1 + (part + made) % 2
                if not held:
                    held = [squeeze(arc_version_block(version, "pages.arc", date))]
                held.append(squeeze(arc_record(version, "pages.arc", url.as_py(), date, page_id.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"))))
                size += len(held[-1])
                if size > ARCHIVE_BYTES:
                    yield _batch(held)
                    held, size, made = [], 0, made + 1
        if held:
            yield _batch(held)

    _write(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "value binary"), path)


def read_arc(spark: SparkSession, path: str, with_record: bool = True) -> DataFrame:
    """(place, version, page_id, payload_sha1, payload_bytes, record as stored) of each record but the version blocks."""
    schema = "place string, version int, page_id long, payload_sha1 string, payload_bytes long" + ", record binary" * with_record
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows, version = [], 1
                for at, stored, data in members(content.as_py()):
                    if data.startswith(b"filedesc://"):
                        version = int(data.partition(b"\n")[2].split(b" ", 1)[0])
                        continue
                    http, _, payload = http_parts(parse_arc(data, version)["block"])
                    page = http.get("x-page-id", "")
                    rows.append((f"{name.as_py()}@{at}", version, int(page) if page else None, hashlib.sha1(payload).hexdigest(), len(payload), stored)[: 5 + with_record])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[c.split()[0] for c in schema.split(", ")])

    return _archives(spark, path).mapInArrow(run, schema)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 1000) -> None:
    """Converts ARC archives to WARC ones. Of records whose payloads are equal and have at least `least` bytes, the one
    with the largest page id stays a response (each one, if that id is repeated) and the others become revisits of it.

    The hot payload has one row among the originals; the join reads two written tables, so its rows can be split over tasks.
    """
    scratch = Scratch(spark, "warc")
    seen = read_arc(spark, arc_path, with_record=False).where(F.col("payload_bytes") >= least)
    originals = seen.groupBy("payload_sha1").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    originals = scratch.save(originals.select("payload_sha1", "original"), "originals")
    # Small payloads meet no original: their place spreads them evenly.
    records = read_arc(spark, arc_path).withColumn("key", F.when(F.col("payload_bytes") >= least, F.col("payload_sha1")).otherwise(F.col("place")))
    joined = records.join(originals.withColumnRenamed("payload_sha1", "key"), "key", "left")
    original = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("original")), F.col("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for place, version, page_id, original, record in zip(*(b.column(i) for i in range(5)), strict=True):
                (_, _, data), = members(record.as_py())
                held.append(squeeze(convert(parse_arc(data, version.as_py()), page_id.as_py(), original.as_py(), place.as_py())))
                size += len(held[-1])
                if size > ARCHIVE_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    _write(joined.select("place", "version", "page_id", original.alias("original"), "record").mapInArrow(run, "value binary"), warc_path)


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """A row for each record: its identifiers, type, address, time, digests, sizes and on request block. Payload size of a revisit: as its head says."""
    schema = "record_id string, record_type string, page_id long, url string, captured string, payload_bytes long, payload_digest string, refers_to_record string, refers_to long" + ", block binary" * with_block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                rows = []
                for _, _, data in members(content.as_py()):
                    f, block = parse_warc(data)
                    http, _, payload = http_parts(block)
                    if sha1_base32(block) != f["warc-block-digest"] or f["warc-type"] == "response" and sha1_base32(payload) != f["warc-payload-digest"]:
                        raise ValueError(f"digest of {f['warc-record-id']} does not match")
                    size = len(payload) if f["warc-type"] == "response" else int(http["content-length"])
                    to, page = f.get("x-refers-to-page-id"), http.get("x-page-id", "")
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((f["warc-record-id"], f["warc-type"], int(page) if page else None, f["warc-target-uri"], f["warc-date"], size, digest, f.get("warc-refers-to"), int(to) if to else None, block)[: 9 + with_block])
                if rows:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[c.split()[0] for c in schema.split(", ")])

    return _archives(spark, path).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages as ARC archives, these as WARC archives in the shared folder, and the records read back from those.

    A row for each row of pages, repeated ones included; other columns are not read; an empty table gives an empty one.
    A null page id is kept null; a null url becomes about:blank.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "archives")
    write_arc(pages, f"{scratch.path}/arc")
    arc_to_warc(spark, f"{scratch.path}/arc", f"{scratch.path}/warc", least)
    scratch.drop("arc")
    return read_warc(spark, f"{scratch.path}/warc", with_block=False)
