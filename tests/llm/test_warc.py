"""Round trips through archives."""

import base64
import collections
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillon.llm import warc
from quillon.llm.common import shared_path

SCHEMA = "page_id bigint, url string, html string, payload string, hex int"


def digest(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(3)


ROWS = [(1, "http://a/", "same"), (2, "http://b/ ü%\r\nX: y", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "other é" * 50), (6, "", "x" * 300_000), (7, "http://g/", "same")]


def test_digest_table(spark):
    got = {r.page_id: r for r in warc.archive_round_trip(frame(spark, ROWS)).collect()}
    groups = collections.defaultdict(list)
    for i, _, h in ROWS:
        groups[h or ""].append(i)
    assert set(got) == {r[0] for r in ROWS}
    for i, _, h in ROWS:
        first = max(groups[h or ""])
        assert got[i].payload_bytes == len((h or "").encode()) and got[i].payload_digest == digest(h)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == first else ("revisit", first))


def test_payloads_and_filters(spark):
    path = shared_path(spark, "test-warc")
    warc.write_archive(frame(spark, ROWS), path, least_bytes=5)
    back = warc.read_archive(spark, path)
    rows = {r.page_id: r for r in back.collect()}
    assert {i: rows[i].url for i in rows} == {i: u for i, u, _ in ROWS}
    for i, _, h in ROWS:
        assert rows[i].record_type == "response" and bytes(rows[i].payload or b"") == (h or "").encode()
    assert [r.page_id for r in back.where("page_id = 5").select("page_id", "payload").collect()] == [5]
    assert back.where(F.col("url").startswith("http://")).count() == 5
    assert back.where("record_type = 'revisit'").count() == 0
    heads = warc.read_archive(spark, path, payload=False)
    assert "payload" not in heads.columns and heads.count() == len(ROWS)
    names = [n for n in os.listdir(path.removeprefix("file:")) if not n.startswith(".")]
    assert names and all(n.endswith(".warc.gz") for n in names)
    whole = b"".join(gzip.open(os.path.join(path.removeprefix("file:"), n)).read() for n in names)
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


def test_foreign_files(spark, tmp_path):
    plain = [warc.record({"page_id": i, "url": f"http://x/{i}", "record_type": "response", "refers_to": None, "payload_bytes": 3, "payload_digest": digest("abc"), "payload": b"abc"}) for i in (1, 2)]
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in plain))
    got = warc.read_archive(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(1, b"abc"), (1, b"abc"), (2, b"abc"), (2, b"abc")]
    assert sorted(r.page_id for r in warc.read_archive(spark, str(tmp_path), payload=False).collect()) == [1, 1, 2, 2]


def test_edges(spark):
    assert warc.archive_round_trip(frame(spark, ROWS).limit(0)).collect() == []
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, "u", "b"), (None, "u", "a")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (None, "response", None), (None, "response", None), (None, "revisit", 1)], key=str)


def foreign(block, *head, end="\r\n"):
    """A record as other programs write it."""
    return end.join(["WARC/1.0", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + 2 * end.encode()


HTTP = b"HTTP/1.1 200 OK\r\nServer: s\r\n"
FOREIGN = [
    foreign(b"software: x/1\n", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>", "Content-Type: application/warc-fields"),
    foreign(b"GET / HTTP/1.1\r\nH: h\r\n\r\n", "WARC-Type: request", "WARC-Target-URI: <http://h/%20a>", "WARC-Record-ID:", " <urn:uuid:1>", "Content-Type: application/http; msgtype=request"),
    foreign(HTTP + b"\r\nbody \r\n\r\n body!", "warc-type:response", "WARC-Target-URI: http://h/%20a", "WARC-Record-ID: <urn:uuid:2>", "WARC-Payload-Digest: sha1:ABC", "Content-Type: application/http;", "\tmsgtype=response"),
    foreign(b"abcd", "WARC-Type: resource", "WARC-Record-ID: <urn:uuid:3>", "WARC-Payload-Digest: md5:1", "Content-Type: text/plain", end="\n"),
    foreign(HTTP + b"Transfer-Encoding: chunked\r\n\r\n3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: application/http"),
    foreign(HTTP + b"\r\n", "WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:5>", "WARC-Refers-To: <urn:uuid:2>", "Content-Type: application/http"),
]


def test_other_programs_archives(spark, tmp_path):
    records = FOREIGN
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))  # one member for all
    want = {("warcinfo", "urn:uuid:0", None, None, 14, None, b"software: x/1\n"), ("request", "urn:uuid:1", "http://h/%20a", None, 0, None, b""), ("response", "urn:uuid:2", "http://h/%20a", None, 15, "ABC", b"body \r\n\r\n body!"), ("resource", "urn:uuid:3", None, None, 4, "md5:1", b"abcd"), ("response", "urn:uuid:4", None, None, 5, None, b"abcde"), ("revisit", "urn:uuid:5", None, "urn:uuid:2", None, None, None)}
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        rows = warc.read_archive(spark, str(tmp_path / name)).collect()
        got = {(r.record_type, r.record_id, r.url, r.refers_to_record, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in rows}
        assert got == want, name
        assert len(rows) == len(records) and all(r.page_id is None and r.refers_to is None for r in rows)
    heads = warc.read_archive(spark, str(tmp_path), payload=False)
    assert heads.where("record_type = 'response'").count() == 6 and heads.where("record_id = 'urn:uuid:3'").count() == 3
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "d.warc").write_bytes(b"".join(records)[:-300])
    with pytest.raises(Exception, match="ends within|no end"):
        warc.read_archive(spark, str(tmp_path / "cut")).collect()


def test_jobs_do_not_touch_each_other(spark, tmp_path):
    path = str(tmp_path / "x")
    warc.write_archive(frame(spark, ROWS), path)
    other = tmp_path / "x" / "_job-other"
    other.mkdir()
    (other / "part-1.warc.gz").write_bytes(b"not yet")
    writer = warc.WarcWriter(path, True, 1 << 20)
    assert warc.read_archive(spark, path, payload=False).count() == len(ROWS)  # nothing goes before the job commits
    writer.abort([])
    assert (other / "part-1.warc.gz").exists() and warc.read_archive(spark, path, payload=False).count() == len(ROWS)
    writer = warc.WarcWriter(path, True, 1 << 20)
    writer.commit([])
    assert (other / "part-1.warc.gz").exists() and warc.read_archive(spark, path, payload=False).count() == 0
