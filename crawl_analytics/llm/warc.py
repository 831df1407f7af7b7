"""WARC records in ZIP packages: written with revisits, read back by ranges through the ZIP directory."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt_name, file_system, stored, whole_file

ARCHIVE_BYTES = 32 << 20  # compressed records after which a package is closed
READ_BYTES = 8 << 20  # neighbouring records are read in one request up to this size
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the ZIP format: signatures of the end record, its 64-bit form and locator, directory entry, local header
END_RECORD, END_RECORD64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
TAIL = 22 + 65535 + 20  # end record with the longest comment, and the locator before it


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One gzip member. A revisit has the HTTP headers only; their Content-Length is the payload's all the same."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = [line.partition(":") for line in lines if ":" in line]
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(data: bytes) -> dict:
    """type, page_id, refers_to, digest, payload_bytes, payload (None in revisits) of one record."""
    raw = gzip.decompress(data)
    top, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(top.decode().split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_fields(http.decode("latin-1").split("\r\n")[1:])["content-length"])
    number = lambda name: int(text) if (text := warc.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or f"sha1:{payload_digest(payload)}" != warc["warc-payload-digest"]):
        raise ValueError(f"record {warc['warc-record-id']}: the payload is not what its digest says")
    return {
        "type": warc["warc-type"],
        "page_id": number("warc-record-id"),
        "refers_to": number("warc-refers-to"),
        "digest": warc["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": length,
        "payload": None if revisit else payload,
        "url": warc.get("warc-target-uri"),
    }


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """Distinct (page_id, payload_sha1) with record_type and refers_to.

    Of pages with equal payloads of at least ``least`` bytes that with the largest page_id is the response.
    Works on ids and digests; the largest id is combined on the map side, and the join back
    is a plain one, so a payload that most pages share is split by adaptive execution.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("payload_sha1"), F.octet_length(html).alias("bytes"))
    narrow = stored(narrow.distinct(), "page-digests")
    first = narrow.where(F.col("bytes") >= least).groupBy("payload_sha1").agg(F.max("page_id").alias("response"))
    found = narrow.join(first, "payload_sha1", "left")
    again = F.col("page_id") < F.col("response")
    return found.select("page_id", "payload_sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"))


def write_packages(pages: DataFrame, root: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one WARC record per row into ZIP packages below ``root``; (package, records, bytes) per package.

    A package holds a stored member of gzip records and a stored index with the place of each in it. Every task writes
    packages of its own, in order, named by its number, and closes one when it is full, so memory is bounded. Lazy: a write happens when
    the result is used.
    """
    choice = decided(pages, least).withColumnsRenamed({"page_id": "__id", "payload_sha1": "__sha1"})
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    rows = rows.join(choice, rows["page_id"].eqNullSafe(choice["__id"]) & (rows["sha1"] == choice["__sha1"]))

    def package(name: str, records: list[tuple], body: io.BytesIO) -> tuple[str, int, int]:
        lines = [json.dumps({"id": i, "type": t, "filename": MEMBER, "offset": a, "length": n}) for i, t, a, n in records]
        with whole_file(f"{root}/{name}", attempt_name()) as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as packed:
                for member, data in ((MEMBER, body.getvalue()), (INDEX, ("\n".join(lines) + "\n").encode())):
                    packed.writestr(zipfile.ZipInfo(member, (2000, 1, 1, 0, 0, 0)), data)
        return f"{root}/{name}", len(records), body.tell()

    def write(batches: Iterator) -> Iterator:
        part, number = TaskContext.get().partitionId(), 0
        records, body = [], io.BytesIO()
        done = []
        for batch in batches:
            cells = (batch.column(c) for c in ("record_type", "page_id", "url", "payload", "refers_to"))
            for kind, page_id, url, payload, refers_to in zip(*cells, strict=True):
                data = _record(kind.as_py(), page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                records.append((page_id.as_py(), kind.as_py(), body.tell(), len(data)))
                body.write(data)
                if body.tell() >= archive_bytes:
                    done.append(package(f"part-{part:06d}-{number:04d}.wacz", records, body))
                    records, body, number = [], io.BytesIO(), number + 1
        if records:
            done.append(package(f"part-{part:06d}-{number:04d}.wacz", records, body))
        columns = list(zip(*done, strict=True)) or [[], [], []]
        types = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["package", "records", "bytes"])

    narrow = rows.select("record_type", "page_id", "url", "payload", "refers_to")
    return narrow.mapInArrow(write, "package string, records long, bytes long")


def directory(read, size: int) -> list[dict]:
    """The central directory of a ZIP file of ``size`` bytes: name, method, size, stored size, place of the local header.

    ``read(begin, length)`` gets bytes of it. Follows the ZIP64 locator and the ZIP64 fields of the entries where
    the 16- and 32-bit fields are full.
    """
    begin = max(0, size - TAIL)
    tail = read(begin, size - begin)
    at = tail.rfind(END_RECORD)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END_RECORD, 0, at)  # the signature inside the comment
    if at < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        place = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
        record = read(place, 56)
        if record[:4] != END_RECORD64:
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    entries, table, at = [], read(start, length), 0
    for _ in range(count):
        if table[at : at + 4] != ENTRY:
            raise ValueError("broken ZIP directory")
        method, stored_size, full_size = struct.unpack("<H8xII", table[at + 10 : at + 28])
        n_name, n_extra, n_note = struct.unpack("<HHH", table[at + 28 : at + 34])
        local = struct.unpack("<I", table[at + 42 : at + 46])[0]
        name = table[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = table[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide, x = b"", 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[x : x + 4])
            if kind == 1:
                wide = extra[x + 4 : x + 4 + n]
            x += 4 + n
        values = []
        for value in (full_size, stored_size, local):
            if value == 0xFFFFFFFF and len(wide) >= 8:
                value, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
            values.append(value)
        entries.append({"name": name, "method": method, "size": values[0], "stored_size": values[1], "local": values[2]})
        at += 46 + n_name + n_extra + n_note
    return entries


def member_start(read, entry: dict) -> int:
    """Where a member's data begins: after its local header, whose extra fields may differ from the directory's."""
    head = read(entry["local"], 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {entry['name']}")
    return entry["local"] + 30 + sum(struct.unpack("<HH", head[26:30]))


def records_index(packages: DataFrame) -> DataFrame:
    """(package) -> (package, begin, length) of every record: the place in the package file itself.

    Reads the directory and the index members, nothing else. Archive members must be stored, an index may be deflated.
    """

    def find(batches: Iterator) -> Iterator:
        for batch in batches:
            for package in batch.column("package").to_pylist():
                system, path = file_system(package)
                with system.open_input_file(path) as file:
                    read = lambda begin, length, f=file: f.read_at(length, begin)
                    members = {e["name"]: e for e in directory(read, file.size())}
                    for name, entry in members.items():
                        if not name.startswith("indexes/"):
                            continue
                        data = read(member_start(read, entry), entry["stored_size"])
                        data = zlib.decompress(data, -15) if entry["method"] == 8 else data
                        lines = [json.loads(line[line.index(b"{") :]) for line in data.splitlines() if b"{" in line]
                        starts = {}
                        for archive in {x["filename"] for x in lines}:
                            archive_entry = members.get(archive) or members[f"archive/{archive}"]
                            if archive_entry["method"] != 0:
                                raise ValueError(f"{package}: {archive} is not a stored member")
                            starts[archive] = member_start(read, archive_entry)
                        for at in range(0, len(lines), 10_000):
                            part = lines[at : at + 10_000]
                            columns = [[package] * len(part), [starts[x["filename"]] + int(x["offset"]) for x in part], [int(x["length"]) for x in part]]
                            types = [pa.string(), pa.int64(), pa.int64()]
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["package", "begin", "length"])

    return packages.select("package").mapInArrow(find, "package string, begin long, length long")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-read the records of (package, begin, length), neighbours in one request; payload is NULL in revisits.

    Nothing is extracted; a task holds one request at a time. Rows in any order are read right, rows in order fast.
    """

    def fetch(batches: Iterator) -> Iterator:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        open_file, opened = None, None
        for batch in batches:
            places = sorted(zip(*(batch.column(c).to_pylist() for c in ("package", "begin", "length")), strict=True))
            while places:
                package, begin, length = places[0]
                end, n = begin + length, 1
                while n < len(places) and places[n][:2] == (package, end) and end + places[n][2] - begin <= READ_BYTES:
                    end, n = end + places[n][2], n + 1
                run, places = places[:n], places[n:]
                if opened != package:
                    system, path = file_system(package)
                    open_file, opened = system.open_input_file(path), package
                data = open_file.read_at(end - begin, begin)
                found = [parse_record(data[a - begin : a - begin + size]) for _, a, size in run]
                rows = [(r["page_id"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"], r["url"], r["payload"] if with_payload else None) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return index.mapInArrow(fetch, RECORD)


def packages_in(spark: SparkSession, root: str) -> DataFrame:
    """(package) for every package file below a folder, listed by Spark; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(root)
    return files.select(F.col("path").alias("package"))


def archived(pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Write all pages to packages below ``root`` and read the records back.

    NULL html is an empty payload, a NULL url is left out, characters that cannot stand in a URI are percent-encoded.
    Rows without a page_id and repeated rows of the largest page_id are responses; other columns are ignored; an empty table
    gives an empty result.
    """
    written = stored(write_packages(pages, root, least), "package-list")
    records = stored(records_index(written), "record-places")
    return read_records(records)
