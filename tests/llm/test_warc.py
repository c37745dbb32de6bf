import base64
import hashlib

import pytest

from barspark.llm import warc


def test_url_key():
    assert warc.url_key("HTTP://user@www.Example.COM:8080/a b?q=1#f") == "com,example:8080)/a%20b?q=1#f"
    assert warc.url_key("m.site.org") == "org,site,m)/"
    assert warc.url_key(None) == ")/"
    assert "\n" not in warc.url_key("http://a/\n b") and " " not in warc.url_key("http://[bad/ x")


def test_record_round_trip():
    body = "é\r\n\r\nWARC/1.1\n".encode()
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert warc.parse_record(warc.record(-3, "http://x/\n", body, digest, None)) == (-3, "response", body, len(body), digest, None)
    assert warc.parse_record(warc.record(None, None, body, digest, 8)) == (None, "revisit", None, len(body), digest, 8)


def brute(rows):
    low, known = {}, {}
    for i, _, h in rows:
        known.setdefault(h or "", []).append(i)
    for h, ids in known.items():
        ids = [i for i in ids if i is not None]
        low[h] = min(ids) if ids else None
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = low[h or ""]
        revisit = first is not None and i != first
        out.append((i, "revisit" if revisit else "response", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), first if revisit else None, None if revisit else b))
    return sorted(out, key=str)


@pytest.mark.parametrize("lines", [1000, 3])
def test_round_trip(spark, tmp_path, lines):
    rows = [(7, "http://a.b/x", "same"), (3, "http://a.b/y", "same"), (9, None, None), (4, "http://q", ""), (5, "http://a.b/x", "x" * 200000), (None, "http://n", "same"), (None, "http://n", "alone"), (12, "http://a.b/x", "é"), (12, "http://a.b/x", "é"), (12, "http://a.b/x", "ü")]
    rows += [(100 + i, f"http://h{i % 5}.example.org/{i}", f"body {i % 9}") for i in range(60)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, file string")
    path = f"file://{tmp_path}"
    directory = warc.build_index(warc.write_archives(df, path), path, lines)
    found = warc.look_up(warc.request_lines(df), directory, path)
    got = warc.read_records(found, path).collect()
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == brute(rows)
    one = spark.createDataFrame([(warc._index_line(warc.url_key("http://h3.example.org/3"), 103),), ("zz 1",), ("", )], "line string")
    assert [r.page_id for r in warc.read_records(warc.look_up(one, directory, path), path).collect()] == [103]


def test_smaller_payloads_are_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = f"file://{tmp_path}"
    directory = warc.build_index(warc.write_archives(df, path, least=3), path)
    got = warc.read_records(warc.look_up(warc.request_lines(df), directory, path), path, False).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
