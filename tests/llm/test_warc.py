import base64
import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from crawl_analytics.llm import common, queries, warc

PAGES = "page_id long, url string, html string"


def by_hand(rows, least=0):
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(page_id, largest.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        again = page_id is not None and len(body) >= least and page_id < largest[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if again else "response", largest[html or ""] if again else None))
    return sorted(out, key=str)


def order(frame):
    return sorted(map(tuple, frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert order(queries.registry()["op9_archives"](spark, sf)) == by_hand(rows)


ODD = [
    (1, "http://a/ü?x=1 2\r\nX: y", "same"),
    (2, None, "same"),
    (3, "", None),
    (4, "u", ""),
    (5, "u", "é\r\n\r\n😀" * 5000),
    (6, "u", "same"),
    (6, "u", "same"),
    (None, "u", "same"),
    (None, None, None),
]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_pages(spark, least):
    pages = spark.createDataFrame(ODD, PAGES).withColumn("payload", F.lit(1)).withColumn("sha1", F.lit("x")).withColumn("record_type", F.lit("y"))
    found = warc.archived(pages, common.folder(spark, "odd-pages"), least)
    assert order(found) == by_hand(ODD, least)
    texts = {(r.page_id, bytes(r.payload).decode()) for r in found.where("record_type = 'response'").collect()}
    assert (5, "é\r\n\r\n😀" * 5000) in texts
    empty = spark.createDataFrame([], PAGES)
    assert warc.archived(empty, common.folder(spark, "no-pages")).count() == 0


def test_small_packages_and_listing(spark):
    rows = [(i, f"http://a/{i}", f"page {i % 7} " * 50) for i in range(60)]
    root = common.folder(spark, "small-packages")
    written = warc.write_packages(spark.createDataFrame(rows, PAGES), root, archive_bytes=300).collect()
    assert len(written) > 3 and sum(r.records for r in written) == 60
    listed = warc.packages_in(spark, root)
    assert listed.count() == len(written)
    places = warc.records_index(listed).orderBy(F.rand(1))
    assert order(warc.read_records(places)) == by_hand(rows)
    system, path = common.file_system(written[0].package)
    with zipfile.ZipFile(path) as package:  # a plain ZIP for everyone else
        assert package.testzip() is None and {i.compress_type for i in package.infolist()} == {zipfile.ZIP_STORED}


def reader(data):
    return lambda begin, length: data[begin : begin + length]


def test_directory_of_a_commented_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", b"hello")
        z.writestr("ü.bin", b"\x00" * 10, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"note PK\x05\x06 " + b"x" * 30
    data = out.getvalue()
    found = warc.directory(reader(data), len(data))
    assert [(e["name"], e["method"], e["size"]) for e in found] == [("a/b.txt", 0, 5), ("ü.bin", 8, 10)]
    begin = warc.member_start(reader(data), found[0])
    assert data[begin : begin + 5] == b"hello"


def test_zip64_directory():
    """All 16- and 32-bit fields full, the values in the ZIP64 records, made by hand."""
    body, name = b"stored data", b"archive/x"
    local = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    prefix = b"#" * 100
    extra = struct.pack("<HH4s", 0xCAFE, 4, b"abcd") + struct.pack("<HHQQQ", 1, 24, len(body), len(body), len(prefix))
    entry = warc.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(prefix) + len(local)
    record = warc.END_RECORD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, start + len(entry), 1)
    end = warc.END_RECORD + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = prefix + local + entry + record + locator + end
    (found,) = warc.directory(reader(data), len(data))
    assert found == {"name": "archive/x", "method": 0, "size": len(body), "stored_size": len(body), "local": len(prefix)}
    begin = warc.member_start(reader(data), found)
    assert data[begin : begin + len(body)] == body


def test_broken_packages():
    with pytest.raises(ValueError):
        warc.directory(reader(b"nothing here"), 12)
    good = warc._record("response", 1, "u", b"text", None)
    assert warc.parse_record(good)["payload"] == b"text"
    import gzip

    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(gzip.decompress(good).replace(b"text\r\n\r\n", b"tExt\r\n\r\n")))
