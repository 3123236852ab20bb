import base64
import hashlib
import io
import zipfile

import pytest

from tailglass.llm.common import scratch
from tailglass.llm.zip_warc import ARCHIVE, ZipReader, ZipWriter, archive_pages, read_packages, write_packages

A, B = "<p>one</p>", "<p>zwei é</p>"
PAGES = [(5, "u5", A, 1), (3, "u3", A, 1), (9, None, B, 1), (4, "u 4\r\nX: y", None, 1), (7, "u7", "", 1), (None, "n", B, 1), (None, "m", "<p>own</p>", 1), (3, "again", A, 1), (2, "u2", "x\r\n\r\nWARC/1.1\r\n" * 9, 1)]


def want(pages):
    none = lambda k: (k is None, k or 0)
    rows = []
    for page, _, html, _ in pages:
        data = (html or "").encode()
        first = min((p for p, _, h, _ in pages if (h or "") == (html or "")), key=none)
        kind = "response" if page == first else "revisit"
        rows.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else first))
    return sorted(rows, key=str)


def test_round_trip(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string, first int")
    assert sorted(map(tuple, archive_pages(frame).collect()), key=str) == want(PAGES)
    for zip64 in (False, True):
        folder = scratch(spark, "zip")
        assert write_packages(frame, folder, zip64=zip64) == len(PAGES)
        assert sorted(map(tuple, read_packages(spark, folder).collect()), key=str) == want(PAGES)
    folder = scratch(spark, "zip")
    write_packages(frame, folder, least_bytes=11)
    assert {r.page_id for r in read_packages(spark, folder).where("record_type = 'revisit'").collect()} == {None}


def test_pages_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html, 0) for r in frame.collect()]
    assert sorted(map(tuple, archive_pages(frame).collect()), key=str) == want(rows)


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    out = io.BytesIO()
    writer = ZipWriter(out, zip64)
    writer.member("a/é.txt", [b"one", b"two"])
    writer.member("b", [])
    writer.close()
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read("a/é.txt") == b"onetwo" and z.read("b") == b""
    package = ZipReader(out, len(out.getvalue()))
    at, n = package.stored("a/é.txt")
    assert package.range(at, n) == b"onetwo" and package.stored("b")[1] == 0


def test_packages_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as f:
            f.write(b"x" * 100)
        z.writestr("packed", b"y" * 100, zipfile.ZIP_DEFLATED)
        for i in range(70_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"%d" % i)
        z.comment = b"PK\x05\x06 a comment"
    package = ZipReader(out, len(out.getvalue()))
    assert len(package.members) == 70_002
    at, n = package.stored("m69999")
    assert package.range(at, n) == b"69999" and package.stored(ARCHIVE)[1] == 100
    with pytest.raises(ValueError):
        package.stored("packed")
    with pytest.raises(ValueError):
        ZipReader(io.BytesIO(b"nothing"), 7)
