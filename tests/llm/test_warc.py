import hashlib
import os
import random
import tempfile

import pytest

from sievework.llm import warc
from sievework.session import scratch_path

PAGES = "page_id bigint, url string, html string, digest string, first string, value string"


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes, inside records, heads and magics."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def plain(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(page, first.get(raw, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        head = first.get(raw, page)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if head == page else "revisit", None if head == page else head))
    return sorted(out, key=str)


def told(spark, rows):
    pages = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)
    return sorted(map(tuple, warc.warc_digest(pages).collect()), key=str)


def whole_record(payload: str, n: int | None = None) -> str:
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:9>\r\nContent-Length: {len(payload) if n is None else n}\r\n\r\n{payload}\r\n\r\n"


def test_odd_rows(spark):
    long = "<p>é</p>" * 40
    rows = [
        (1, "http://a/", long), (2, None, long), (0, "http://ü/ x\n\r\ny%", long), (0, "u", long), (None, "n", long), (None, "n", "alone"), (3, "", None), (4, "e", ""),
        (5, "s", "x" * 99), (6, "s", "x" * 99), (7, "s", "x" * 100), (8, "s", "x" * 100), (-5, "s", "x" * 100), (9, "big", "0123456789" * 300_000),
    ]
    assert told(spark, rows) == plain(rows)
    assert told(spark, []) == []


def test_archives_inside_archives(small_splits):
    inner = whole_record("deep") + whole_record("x" * 300) + whole_record("lie", 7) + whole_record("far", 5000)
    rows = [
        (1, "u", inner), (2, "u", "\r\n\r\n" + inner), (3, "u", "WARC/1.1\r\n"), (4, "u", "\r\n\r\nWARC/1."), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n"),
        (6, "u", whole_record(whole_record(inner)) * 3), (7, "u", "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n"), (8, "u", "z" * 5000), (9, "u", "\r\n" * 700), (10, "u", inner),
    ]
    assert told(small_splits, rows) == plain(rows)


def test_random_pieces_of_the_separator(small_splits):
    rnd = random.Random(11)
    pieces = ["\r\n", "\r\n\r\n", "\r", "\n", "WARC/1.", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 12\r\n\r\n", "\r\n\r\nWARC/", "text ", "é", "\0", ":"]
    rows = [(i, "u", "".join(rnd.choices(pieces, k=rnd.randrange(0, 60)))) for i in range(60)]
    assert told(small_splits, rows) == plain(rows)


def test_line_ends_at_the_readers_buffer(spark):
    """Payloads that end in a line end, over every place of the reader's buffer."""
    rows = [(i, "u", "x" * (65_000 + i) + "\r\n" * (i % 3)) for i in range(0, 400, 5)]
    assert told(spark, rows) == plain(rows)


def test_payloads_come_back(small_splits):
    rows = [(1, "http://a/?q=1", "body " * 50), (2, "b", whole_record("in")), (3, "b", "body " * 50)]
    path = scratch_path(small_splits, "warc-test")
    warc.write_warc(small_splits.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    got = {r.record_id: r for r in warc.read_warc(small_splits, path).collect()}
    assert bytes(got["urn:x-page:1"].payload) == rows[0][2].encode() and got["urn:x-page:1"].uri == "http://a/?q=1"
    assert bytes(got["urn:x-page:2"].payload) == rows[1][2].encode()
    assert got["urn:x-page:3"].type == "revisit" and bytes(got["urn:x-page:3"].payload) == b"" and got["urn:x-page:3"].refers_to == "urn:x-page:1"
    assert warc.broken_files(small_splits, path).collect() == []


def test_broken_chain_ends_its_file_only(spark):
    folder = tempfile.mkdtemp(prefix="warc-broken-")
    good = whole_record("one") + whole_record("two")
    files = {"a": good, "b": good + whole_record("three", 2) + whole_record("four"), "c": "noise" + good, "d": good[:-30], "e": good + "WARC/1.1\r\nNo-Length: 1\r\n\r\n\r\n\r\n" + good}
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(text)
    got = sorted((os.path.basename(r.file), bytes(r.payload).decode()) for r in warc.read_warc(spark, folder).collect())
    assert got == [("a", "one"), ("a", "two"), ("b", "one"), ("b", "two"), ("d", "one"), ("e", "one"), ("e", "two")]
    assert sorted(os.path.basename(r.file) for r in warc.broken_files(spark, folder).collect()) == ["b", "c", "d", "e"]
