import base64
import gzip
import hashlib
import re

import pytest

from lexilink.llm import warc


def test_arc_versions_and_declared_lengths():
    records = [
        {"url": "http://a.org/x y", "date": "19990102030405", "content": b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nline\n\nWARC/1.0\nhttp://x 1 2 3 4\n"},
        {"url": "http://b.org/", "date": "199901020304", "content": b"", "mime": "text/plain"},
        {"url": "http://c.org/", "date": "bad", "content": b"plain\n"},
    ]
    for version in (1, 2):
        found = list(warc.parse_arc(warc.arc_file(records, version)))
        assert [r.content for r in found] == [r["content"] for r in records]
        assert set(found[0].fields) == set(warc.ARC_FIELDS[version])
        made = [warc.synthesise(r) for r in found]
        assert [m["date"] for m in made] == ["1999-01-02T03:04:05Z", "1999-01-02T03:04:00Z", "1970-01-01T00:00:00Z"] or version
        assert [m["type"] for m in made] == ["response", "resource", "resource"]
        assert made[0]["payload_digest"] == base64.b32encode(hashlib.sha1(b"line\n\nWARC/1.0\nhttp://x 1 2 3 4\n").digest()).decode()
        assert len({m["record_id"] for m in made}) == 3
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_file(records, 1)[:-20]))
    spaced = b"filedesc://f 0 19990101000000 text/plain 4\n1 0 x\nhttp://a b c 1.2.3.4 19990101000000 text/html 2\nhi\n"
    assert next(warc.parse_arc(spaced.replace(b"text/plain 4", b"text/plain 5"))).fields["URL"] == "http://a b c"


HTML = [(1, "u", "same"), (2, "u", "same"), (30, None, "same"), (4, "http://x/ y\r\nz", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n"), (7, "u", "x" * 300_000), (7, "u", "x" * 300_000), (None, "u", "same")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in HTML], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(map(tuple, warc.warc_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    largest = {}
    for page, _, html in HTML:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = []
    for page, _, html in HTML:
        html = html or ""
        first = (-1 if page is None else page) == largest[html]
        want.append((page, len(html.encode()), digest(html), "response" if first else "revisit", None if first else largest[html]))
    assert got == sorted(want, key=repr)


def test_least_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.warc_round_trip(df, least_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_archives_of_many_records(spark):
    """Archives given as such, of either version, with several records each; ids come along or are null."""
    page = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody"
    records = [{"url": f"http://a.org/{i}", "date": f"200{i}0102030405", "content": page if i < 3 else b"%d" % i} for i in range(5)]
    rows = [([1, 2, 3, 4, 5], bytearray(warc.arc_file(records, 1))), ([11, 12, 13, 14, 15], bytearray(warc.arc_file(records, 2))), (None, bytearray(warc.arc_file(records[:1], 2))), (None, bytearray(warc.arc_file([], 1)))]
    path = warc.fresh_path(spark, "test-warc")
    warc.write_warc(warc.arc_records(spark.createDataFrame(rows, "page_ids array<long>, arc binary")), path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.url, r.date) for r in warc.read_warc(spark, path).collect()), key=repr)
    want = [(i + base, ("response" if i + base == 13 else "revisit") if i <= 3 else ("resource" if base else "revisit"), None if (i + base == 13 or i > 3 and base) else (13 if i <= 3 else i + 10), f"http://a.org/{i - 1}", f"200{i - 1}-01-02T03:04:05Z") for base in (0, 10) for i in range(1, 6)]
    assert got == sorted([*want, (None, "revisit", 13, "http://a.org/0", "2000-01-02T03:04:05Z")], key=repr)


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_files_of_others(spark, tmp_path, pack):
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{}Content-Length: {}\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nhi"
    content = (head.format("warcinfo", "", 3).encode() + b"a: \r\n\r\n") + (head.format("response", "WARC-Target-URI: http://a/\r\n b\r\nContent-Type: application/http\r\n", len(block)).encode() + block + b"\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(pack(content))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.url) for r in warc.read_warc(spark, str(tmp_path), "*.warc").collect()]
    assert got == [(None, 3, "warcinfo", None), (None, 2, "response", "http://a/ b")]


def test_files_are_many_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CHUNKS", 2)
    df = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "concat(uuid(), repeat(uuid(), 20)) AS html").coalesce(1)
    path = warc.fresh_path(spark, "test-warc")
    warc.write_warc(warc.page_records(df, "page_id", "url", "html", 5000), path, chunk_bytes=2000)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(files) > 5 and max(f.length for f in files) < 10_000
    assert warc.read_warc(spark, path).count() == 200
    dates = {re.sub("T.*", "", r.date) for r in warc.read_warc(spark, path).select("date").collect()}
    assert len(dates) > 5
