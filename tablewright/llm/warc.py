"""WARC archives: writing with segmented records, and segment reassembly.

Writing: every page is a response record whose HTTP body is framed in chunks;
a block longer than ``segment_bytes`` is split into a first record and
continuation records that name its identifier (WARC-Segment-Origin-ID,
WARC-Segment-Number, and the total length on the last). Of pages with equal
payloads of at least ``revisit_bytes``, the one with the smallest id is
written in full and the others as revisit records. Archives are written by
Spark's text writer, gzip-compressed, with a bounded number of records of
bounded size per file.

Reading: archives are parsed by Content-Length; records in one piece are
decoded in place, pieces are grouped by origin identifier, ordered by segment
number, and the total length is verified before the chunked framing is
decoded. A record with a missing or surplus segment or a wrong length keeps
its row, with a null payload and the problem named.

Defined cases: null payloads are empty; a null url is an empty target; pages
with equal ids and payloads are separate records (of such rows of the smallest
id, each is a response); a null id is written as ``null`` and read as null;
an empty table gives archives without records; further columns are not read.
"""

from __future__ import annotations

import gzip
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

SEGMENT_BYTES = 64 << 10
RECORDS_PER_FILE = 2048
REVISIT_BYTES = 100
#: Chunk length of the transfer framing.
CHUNK = 8 << 10

EOL = b"\r\n"
BREAK = "\r\n\r\n"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"


def _record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items() if v != ""),
             f"Content-Length: {len(block)}".encode()]
    return EOL.join(lines) + EOL + EOL + block


def pieces_of(data: bytes, size: int) -> list[bytes]:
    """``data`` in pieces of at most ``size`` bytes, cut between characters."""
    out, at = [], 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data) and stop > at + 1 and data[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(data[at:stop])
        at = stop
    return out


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in pieces_of(payload, size)) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    at, out = 0, []
    while True:
        eol = body.index(EOL, at)
        size = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != EOL:
            raise ValueError("chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def _urn(page_id, *more) -> str:
    """A page's URN; a record's identifier adds a part of its own to it."""
    return f"<urn:page:{':'.join(str(x) for x in ('null' if page_id is None else page_id, *more))}>"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE,
                   revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write ``pages`` as WARC archives into the new folder ``path``."""
    source = pages.select(F.col(page_id).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"),
                          F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    digest = F.sha2("payload", 256).alias("digest")
    long = F.length("payload") >= revisit_bytes
    # One row per repeated payload; a group of any size is one row per task.
    firsts = (source.where(long).select("page_id", digest).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("digest").alias("same"), "first"))
    firsts = written(firsts, "warc-firsts")
    # The texts stay where they are: only ids and digests meet the groups.
    rows = source.select("page_id", digest, long.alias("long")).where("long")
    repeats = rows.join(firsts, F.col("digest") == F.col("same")).where(
        "page_id > first or (page_id is null and first is not null)")
    repeats = written(repeats.select("page_id", "first", F.lit(True).alias("again"), "digest").distinct(), "warc-repeats")
    typed = (source.withColumn("digest", digest).alias("s")
             .join(repeats.alias("r"), F.col("s.page_id").eqNullSafe(F.col("r.page_id"))
                   & (F.col("s.digest") == F.col("r.digest")), "left")
             .select("s.page_id", "s.url", "s.payload", "s.digest", "r.first", F.col("r.again").isNotNull().alias("again")))

    def records(batches):
        for b in batches:
            out: list[str] = []
            size = 0
            for page, target, payload, sha, first, again in zip(*(c.to_pylist() for c in b.columns)):
                own = uuid.uuid4().hex
                common = {"WARC-Record-ID": _urn(page, own), "WARC-Date": DATE,
                          "WARC-Target-URI": " ".join(target.split()), "WARC-Payload-Digest": f"sha256:{sha}",
                          "Content-Type": "application/http; msgtype=response"}
                status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if again:
                    headers = {"WARC-Type": "revisit", **common, "WARC-Refers-To": _urn(first),
                               "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    out.append(_record(headers, status).decode())
                    continue
                block = status + frame(payload)
                cuts = pieces_of(block, segment_bytes)
                for part, piece in enumerate(cuts, 1):
                    if len(cuts) == 1:
                        headers = {"WARC-Type": "response", **common}
                    elif part == 1:
                        headers = {"WARC-Type": "response", **common, "WARC-Segment-Number": "1"}
                    else:
                        headers = {"WARC-Type": "continuation", "WARC-Record-ID": _urn(page, own, part), "WARC-Date": DATE,
                                   "WARC-Segment-Origin-ID": _urn(page, own), "WARC-Segment-Number": str(part)}
                        if part == len(cuts):
                            headers["WARC-Segment-Total-Length"] = str(len(block))
                    out.append(_record(headers, piece).decode())
                    size += len(piece)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": out})
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": out})

    (typed.mapInArrow(records, "value string").write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def _parsed(data: bytes):
    """Yield ``(headers, block)`` of the records of one archive's bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(VERSION[:5], at)) >= 0:
        head = data.find(EOL + EOL, at)
        if head < 0:
            return
        headers = {}
        for line in data[at:head].split(EOL)[1:]:
            k, _, v = line.partition(b":")
            headers[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = int(headers.get("content-length", "0"))
        yield headers, data[head + 4:head + 4 + size]
        at = head + 4 + size


def _payload(block: bytes) -> tuple[bytes | None, str | None]:
    """Payload of an HTTP response block, and what is wrong with it."""
    head, gap, body = block.partition(EOL + EOL)
    if not gap:
        return None, "no end of the HTTP header"
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in
              (x.partition(b":") for x in head.split(EOL)[1:])}
    try:
        if fields.get(b"transfer-encoding") == b"chunked":
            body = unframe(body)
        if fields.get(b"content-encoding") == b"gzip":
            body = gzip.decompress(body)
    except (ValueError, OSError, EOFError, zlib.error) as e:
        return None, f"broken body: {e}"
    return body, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, record_type, target, payload_digest, refers_to, payload,
    problem)``: one row per logical record of the archives in ``path``, of
    whatever type. The payload of an HTTP message (by its content type; a response
    without one counts as such) is its decoded body, that of any other record its
    block."""
    def pieces(batches):
        names = ["record_id", "record_type", "target", "digest", "refers_to", "http", "segment", "total", "block"]
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for data in b.column(0):
                out, size = [], 0
                for h, block in _parsed(data.as_py()):
                    kind = h.get("warc-type", "")
                    total, media = h.get("warc-segment-total-length"), h.get("content-type", "").lower()
                    out.append((h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id"),
                                kind, h.get("warc-target-uri", ""), h.get("warc-payload-digest"),
                                h.get("warc-refers-to"), media.startswith("application/http") or not media and kind == "response",
                                int(h.get("warc-segment-number", "0")),
                                int(total) if total else None, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def decoded(batches):
        for b in batches:
            keep = [b.column(i) for i in range(5)]
            got = [(None, p) if p else (None, None) if k == "revisit" else _payload(x) if http else (x, None)
                   for k, http, x, p in zip(*(b.column(i).to_pylist() for i in (1, 5, 6, 7)))]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
                names=["record_id", "record_type", "target", "payload_digest", "refers_to", "payload", "problem"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        pieces, "record_id string, record_type string, target string, digest string, refers_to string, "
                "http boolean, segment int, total long, block binary")
    found = written(found, "warc-pieces")
    whole = found.where("segment = 0").select(
        "record_id", "record_type", "target", "digest", "refers_to", "http", "block",
        F.lit(None).cast("string").alias("problem"))
    # The segments of one record: as many as its length needs, ordered by number.
    parts = (found.where("segment > 0").groupBy("record_id").agg(
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
        F.max(F.when(F.col("segment") == 1, F.col("target"))).alias("target"),
        F.max("digest").alias("digest"), F.max("refers_to").alias("refers_to"),
        F.max(F.when(F.col("segment") == 1, F.col("http"))).alias("http"), F.max("total").alias("total"),
        F.expr("array_sort(collect_list(struct(segment, block)))").alias("parts")))
    joined = parts.selectExpr(
        "record_id", "record_type", "target", "digest", "refers_to", "coalesce(http, false) as http",
        "unhex(array_join(transform(parts, p -> hex(p.block)), '')) as block",
        "case when transform(parts, p -> p.segment) != sequence(1, size(parts)) then 'segments missing or repeated' "
        "when total is null then 'no last segment' "
        "when aggregate(parts, 0L, (a, p) -> a + length(p.block)) != total then 'wrong total length' end as problem")
    return whole.unionByName(joined).mapInArrow(
        decoded, "record_id string, record_type string, target string, payload_digest string, refers_to string, "
                 "payload binary, problem string")


def resolved(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to,
    problem)`` per response, revisit or orphaned segment (records of other types
    are no pages and have no row): lengths and digests of the payloads as read, and
    for a revisit those of the record that it refers to."""
    page = "try_cast(regexp_extract({}, '<urn:page:(-?[0-9]+)[:>]', 1) as bigint)"
    seen = written(records.select(
        F.expr(page.format("record_id")).alias("page_id"), "record_type",
        F.expr(page.format("refers_to")).alias("refers_to"), "problem", "payload_digest",
        F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("sha")), "warc-records")
    full = (seen.where("record_type = 'response' and problem is null")
            .select(F.col("page_id").alias("first_id"), F.concat(F.lit("sha256:"), "sha").alias("first_digest"),
                    F.col("payload_bytes").alias("first_bytes"), F.col("sha").alias("first_sha")).distinct())
    full = written(full, "warc-responses")
    again = seen.where("record_type = 'revisit'").join(
        full, (F.col("refers_to") == F.col("first_id")) & (F.col("payload_digest") == F.col("first_digest")), "left")
    again = again.select("page_id", "record_type", "refers_to", F.col("first_bytes").alias("payload_bytes"),
                         F.col("first_sha").alias("sha"),
                         F.coalesce("problem", F.when(F.col("first_id").isNull(), "no such response")).alias("problem"))
    once = seen.where("record_type is null or record_type = 'response'").select(
        "page_id", "record_type", "refers_to", "payload_bytes", "sha", "problem")
    return once.unionByName(again).select(
        "page_id", "payload_bytes", F.col("sha").alias("payload_digest"), "record_type", "refers_to", "problem")
