"""WARC writing, segment reassembly and decoding."""

import gzip
import hashlib
import os

import pytest

from tablewright.llm import warc
from tablewright.session import scratch_path

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == body]
        first = min((j for j in same if j is not None), default=None)
        again = len(body) >= 100 and first is not None and (i is None or i > first)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                    first if again else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' as digest", "1 as first", "2 as payload").repartition(3)


@pytest.mark.parametrize("segment", [warc.SEGMENT_BYTES, 777])
def test_round_trip(spark, segment):
    long = "<p>é€𝄞 WARC/1.1\r\nWARC-Type: response\r\n\r\n</p>\r\n\r\n" * 3000
    rows = [(1, "http://a/", "x" * 99), (2, "http://b/", "x" * 99), (3, "u", "x" * 100), (4, "u", "x" * 100),
            (5, None, None), (6, "u", ""), (7, "line\r\nbreak", long), (8, "u", long), (9, "u", long + "."),
            (3, "u", "x" * 100), (9, "u", long + "."), (None, "u", "y" * 200), (None, "u", "y" * 200), (10, "u", "y" * 150)]
    path = scratch_path(spark, "t")
    warc.write_archives(frame(spark, rows), path, segment_bytes=segment, records_per_file=5)
    records = warc.read_archives(spark, path)
    got = warc.resolved(records)
    assert got.where("problem is not null").count() == 0
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == expected(rows)
    payloads = {bytes(r["payload"]) for r in records.where("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, _, h in rows}


def test_empty_table(spark):
    path = scratch_path(spark, "t")
    warc.write_archives(frame(spark, []), path)
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0


def record(kind, rid, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, **{k.replace("_", "-"): v for k, v in more.items()}}
    return warc._record(head, block) + b"\r\n\r\n"


def test_broken_segments_are_named(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.frame(b"abcdefghij" * 10, 7)
    third = len(block) // 3

    def pieces(page, parts, total):
        origin = f"<urn:page:{page}:o>"
        out = []
        for n, piece in parts:
            more = {"WARC_Segment_Number": str(n)}
            if n > 1:
                more["WARC_Segment_Origin_ID"] = origin
            if n == 3:
                more["WARC_Segment_Total_Length"] = str(total)
            out.append(record("response" if n == 1 else "continuation", origin if n == 1 else f"<urn:x:{page}{n}>",
                              piece, **more))
        return out

    cut = [(1, block[:third]), (2, block[third:2 * third]), (3, block[2 * third:])]
    files = {"a.warc": pieces(1, cut[::-1], len(block))[:1] + pieces(2, cut, len(block)),
             "b.warc.gz": pieces(1, cut[::-1], len(block))[1:] + pieces(3, [cut[0], cut[2]], len(block)),
             "c.warc": pieces(4, cut, len(block) + 1) + pieces(5, cut[:2], len(block)),
             "d.warc": [record("response", "<urn:page:6:o>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"),
                        record("warcinfo", "<urn:i>", b"hello"),
                        record("response", "<urn:page:7:o>", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n"
                               + gzip.compress(b"plain"))]}
    for name, records in files.items():
        body = b"".join(records)
        (tmp_path / name).write_bytes(gzip.compress(body) if name.endswith("gz") else body)
    got = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    by = {i: got[f"<urn:page:{i}:o>"] for i in range(1, 8)}
    assert bytes(by[1]["payload"]) == bytes(by[2]["payload"]) == b"abcdefghij" * 10
    assert [by[i]["problem"] for i in (3, 4, 5)] == [
        "segments missing or repeated", "wrong total length", "no last segment"]
    assert by[6]["problem"].startswith("broken body") and bytes(by[7]["payload"]) == b"plain"
    assert len(got) == 8 and bytes(got["<urn:i>"]["payload"]) == b"hello"


def test_archives_have_bounded_files(spark):
    path = scratch_path(spark, "t")
    rows = [(i, "u", f"page {i} " * 20) for i in range(50)]
    warc.write_archives(frame(spark, rows).coalesce(1), path, records_per_file=20)
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".gz")]) == 3


def test_records_of_every_type_are_read(spark, tmp_path_factory):
    """Archives of other origin: resources, metadata, requests and info records."""
    folder = str(tmp_path_factory.mktemp("other"))

    def record(kind, block, **headers):
        lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x:" + kind + b">"]
        lines += [k.replace("_", "-").encode() + b": " + v for k, v in headers.items()]
        return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    data = (record(b"warcinfo", b"software: x", Content_Type=b"application/warc-fields")
            + record(b"resource", b"<p>raw</p>", Content_Type=b"text/html", WARC_Target_URI=b"http://a/")
            + record(b"request", b"GET / HTTP/1.1\r\n\r\n", Content_Type=b"application/http; msgtype=request")
            + record(b"response", http, Content_Type=b"application/http; msgtype=response")
            + record(b"conversion", b"text", Content_Type=b"text/plain"))
    with open(f"{folder}/a.warc", "wb") as f:
        f.write(data)
    got = {r["record_type"]: r for r in warc.read_archives(spark, folder).collect()}
    assert {k: (bytes(r["payload"]), r["problem"]) for k, r in got.items()} == {
        "warcinfo": (b"software: x", None), "resource": (b"<p>raw</p>", None), "request": (b"", None),
        "response": (b"body", None), "conversion": (b"text", None)}
    assert got["resource"]["target"] == "http://a/"
