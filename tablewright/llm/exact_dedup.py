"""Exact deduplication by content-defined chunk recipes.

Each normalised text (A-Z lower-cased; null counts as empty) is cut where a
rolling hash of the last 32 bytes hits a pattern, so equal passages are cut
alike wherever they stand. A chunk catalogue, one row per distinct chunk
body after a map-side combine, shows which fingerprints stand for exactly
one body; only a fingerprint with several bodies (a collision) gets ordinals.
A document is then its recipe, the ordered list of verified chunk
identifiers, about 1/100 of its text; recipes are grouped and compared
whole, and the texts themselves are never shuffled again.

Defined cases: null and empty texts have the empty recipe and are equal;
repeated rows and equal doc_ids are rows of one group (the largest doc_id
stays, and of several rows with it every one is marked kept); a null doc_id
is never the one that stays unless all of its group are null; an empty table
gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import raw, slices
from .store import written

#: Average chunk of 2**AVERAGE_BITS bytes, and the longest.
AVERAGE_BITS = 11
LONGEST = 1 << 16
FINGERPRINT = 16

_GEAR = np.frombuffer(hashlib.shake_128(b"chunk boundaries").digest(1024), "<u4")


def normalised(text: str) -> str:
    """SQL of a text as it is compared: A-Z lower-cased, null as empty."""
    return (f"translate(coalesce(`{text}`, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz')")


def cut_points(buf: np.ndarray, average_bits: int = AVERAGE_BITS, longest: int = LONGEST) -> np.ndarray:
    """Chunk ends of one text: where the gear hash of 32 bytes ends in zeros
    from the top, and every ``longest`` bytes without such a place."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    h = _GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[step:] = h[:-step] if step < n else h[:0]
        h = h + (older << np.uint32(step))
    ends = np.flatnonzero(h >> np.uint32(32 - average_bits) == 0) + 1
    ends = np.append(ends[ends < n], n)
    begins = np.append(0, ends[:-1])
    long = np.flatnonzero(ends - begins > longest)
    if len(long):
        forced = [np.arange(begins[i] + longest, ends[i], longest) for i in long]
        ends = np.unique(np.concatenate([ends, *forced]))
    return ends


def fingerprint(body: bytes, size: int = FINGERPRINT) -> bytes:
    return hashlib.blake2b(body, digest_size=size).digest()


def _chunks(body: np.ndarray, off: np.ndarray, size: int):
    """Per row: (normalised bytes, [(fingerprint, begin, end), ...])."""
    for i in range(len(off) - 1):
        text = body[off[i]:off[i + 1]]
        whole, at, out = text.tobytes(), 0, []
        for end in cut_points(text).tolist():
            out.append((fingerprint(whole[at:end], size), at, end))
            at = end
        yield whole, out


def catalogue(docs: DataFrame, text: str = "text", size: int = FINGERPRINT) -> DataFrame:
    """One row ``(fp, body)`` per distinct chunk of all texts."""
    def bodies(batches):
        for b in batches:
            for _, _, buf, off in slices(b.column(0)):
                seen: dict[tuple[bytes, bytes], None] = {}
                for whole, parts in _chunks(buf, off, size):
                    for fp, at, end in parts:
                        seen[fp, whole[at:end]] = None
                if seen:
                    yield pa.RecordBatch.from_pydict(
                        {"fp": pa.array([k[0] for k in seen], pa.binary()),
                         "body": pa.array([k[1] for k in seen], pa.binary())})

    return docs.select(F.col(text)).mapInArrow(bodies, "fp binary, body binary").distinct()


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            size: int = FINGERPRINT) -> DataFrame:
    """``(doc_id, recipe, text_sha256)``: the chunk identifiers in order."""
    def listed(batches):
        for b in batches:
            ids = b.column(0)
            for lo, hi, buf, off in slices(b.column(1)):
                found = list(_chunks(buf, off, size))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo),
                     pa.array([b"".join(p[0] for p in parts) for _, parts in found], pa.binary()),
                     pa.array([hashlib.sha256(w).hexdigest() for w, _ in found], pa.string())],
                    names=["doc_id", "recipe", "text_sha256"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(listed, f"doc_id {kind}, recipe binary, text_sha256 string")


def _with_ordinals(docs: DataFrame, bad: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Recipes when fingerprints collide: each chunk occurrence is joined to
    the catalogue's ordinals by fingerprint and body, and lists are rebuilt."""
    def occurrences(batches):
        for b in batches:
            rows, shas = b.column(0), b.column(2)
            off, body = raw(b.column(1))
            for i in range(b.num_rows):
                for _, _, buf, cut in slices(b.column(1).slice(i, 1)):
                    for whole, parts in _chunks(buf, cut, size):
                        yield pa.RecordBatch.from_pydict({
                            "row": pa.array([rows[i].as_py()] * len(parts), pa.int64()),
                            "pos": pa.array(range(len(parts)), pa.int64()),
                            "fp": pa.array([p[0] for p in parts], pa.binary()),
                            "body": pa.array([whole[p[1]:p[2]] for p in parts], pa.binary())})

    spark = docs.sparkSession
    source = written(docs.select(F.monotonically_increasing_id().alias("row"),
                                 F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "dedup-rows")
    sha = F.sha2(F.encode(F.expr(normalised("text")), "UTF-8"), 256)
    occ = (source.select("row", "text", F.lit("").alias("none"))
           .mapInArrow(occurrences, "row long, pos long, fp binary, body binary"))
    named = occ.join(bad, ["fp", "body"], "left").select(
        "row", "pos", F.concat("fp", F.unhex(F.lpad(F.hex(F.coalesce("ordinal", F.lit(0))), 8, "0"))).alias("id"))
    lists = named.groupBy("row").agg(
        F.expr("aggregate(transform(array_sort(collect_list(struct(pos, id))), x -> x.id), X'', (a, b) -> a || b)")
        .alias("recipe"))
    return (source.select("row", "doc_id", sha.alias("text_sha256")).join(lists, "row", "left")
            .select("doc_id", F.coalesce("recipe", F.expr("X''")).alias("recipe"), "text_sha256"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                fingerprint_bytes: int = FINGERPRINT) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row.

    Rows whose normalised texts are equal form a group; the row with the
    largest ``doc_id`` stays. A group of any size costs one row per map task
    in the grouping, and its rows meet the group's single row in a join whose
    hot partitions adaptive execution splits (both of its sides come straight
    from an exchange).
    """
    ids = catalogue(docs, text, fingerprint_bytes)
    clashes = ids.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    clashes = written(clashes, "dedup-clashes")
    if clashes.isEmpty():
        listed = recipes(docs, doc_id, text, fingerprint_bytes)
    else:
        ranked = ids.join(clashes, "fp", "left_semi").selectExpr(
            "fp", "body", "cast(row_number() over (partition by fp order by body) as int) as ordinal")
        listed = _with_ordinals(docs, written(ranked, "dedup-ordinals"), doc_id, text, fingerprint_bytes)
    listed = written(listed, "dedup-recipes")
    groups = (listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"),
                                           F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1"))
    groups = written(groups.withColumnRenamed("recipe", "group_recipe"), "dedup-groups")
    out = listed.join(groups, listed["recipe"] == groups["group_recipe"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"),
                      F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
