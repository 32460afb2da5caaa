"""Corpus pipeline: from ``documents`` to a training mix.

Five stages, each over all rows that its predecessor kept, written as Parquet
to the shared folder and read again: documents without a recognisable
language go; of equal texts one stays; of near copies (linked by Jaccard
similarity of word shingles) one stays; documents with benchmark passages go;
the rest is mixed to the sources' target weights.

A document is known by its id and a hash of its text, so rows of one id with
different texts, and rows without an id, are documents of their own; rows
equal in both are one document (exact dedup keeps one of them, the other
stages keep or drop them together).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixture
from tablewright.llm.store import read, scratch, written

#: Hash slots by which rows are told from those that go: 2**20, 8 MB of longs.
SLOTS = 1 << 20
#: Whole key of a document; a missing id sorts last.
KEY = "struct(doc_id is null as nameless, doc_id, xxhash64(text) as text_hash)"


def _packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row of ``docs`` as one column ``document`` beside the named ones, so
    that no column of ``docs`` meets a name used here."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document"),
                       *[c.alias(name) for name, c in more.items()])


def _slot(key: str) -> Column:
    return F.expr(f"pmod(xxhash64({key}), {SLOTS})")


def _met(docs: DataFrame, key: Column, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(apart, met)``: the rows of ``docs``, and the packed ones with their
    ``key`` and ``slot``, whose hash slot (of SLOTS) no key, or some key, of the
    written ``table`` (one column, ``gone``) has. Only the latter, few while the
    table is small beside SLOTS, need to be moved to meet it."""
    taken = table.select(_slot("gone").alias("slot")).distinct()
    rows = _packed(docs, key=key).join(F.broadcast(taken), _slot("key") == F.col("slot"), "left")
    return rows.where("slot is null").select("document.*"), rows.where("slot is not null")


def _same(met: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Joins rows of :func:`_met` with ``table`` by key. The slot, which comes from
    the broadcast, is part of the condition: without it the optimiser would move
    this join below the broadcast and all documents with it."""
    table = table.select("gone", _slot("gone").alias("gone_slot"))
    return met.join(table, (F.col("key") == F.col("gone")) & (F.col("slot") == F.col("gone_slot")), how)


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the written table ``gone``."""
    apart, met = _met(docs, key, gone)
    return apart.unionByName(_same(met, gone, "left_anti").select("document.*"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is ``und``. The model learns from
    the same rows as the language query: those whose fold is not held out."""
    with scratch(spark):
        model = language_id.learned(docs, language_id.crc_fold("doc_id", 4) == 2)
    packed = _packed(docs, doc_id=docs["doc_id"], text=docs["text"])
    found = language_id.identify(packed, model, keep=("document",))
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("document.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (the largest id). A row
    that stands several times with its id and text stays once."""
    sha = F.sha2(F.encode(F.expr(exact_dedup.normalised("text")), "UTF-8"), 256)
    key = F.struct(docs["doc_id"].isNull().alias("nameless"), docs["doc_id"], sha.alias("sha"))
    with scratch(spark) as tables:
        found = exact_dedup.exact_dedup(docs).selectExpr(
            "struct(doc_id is null as nameless, doc_id, text_sha256 as sha) as gone", "kept")
        found = written(found, "dedup-result")
        gone = written(found.where("not kept").select("gone").distinct(), "gone")
        again = written(found.where("kept").groupBy("gone").count().where("count > 1").select("gone"), "again")
        tables.keep(gone, again)
    apart, met = _met(docs, key, gone.unionByName(again))
    left = _same(met, gone.unionByName(again), "left_anti")
    once = _same(met, again, "left_semi").dropDuplicates(["key"])
    return apart.unionByName(left.unionByName(once).select("document.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near copies stays (the smallest id)."""
    with scratch(spark) as tables:
        members, _ = jaccard_join.jaccard_join(docs.select(F.expr(KEY).alias("doc_id"), "text"), counts=False)
        gone = members.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
        gone = written(gone, "gone")
        tables.keep(gone)
    return _without(docs, F.expr(KEY), gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    with scratch(spark) as tables:
        keyed = docs.select(F.expr(KEY).alias("doc_id"), "text")
        found = decontaminate.decontaminate(keyed, read(spark, sf_dir, "benchmark"))
        gone = written(found.where("contaminated").select(F.col("doc_id").alias("gone")).distinct(), "gone")
        tables.keep(gone)
    return _without(docs, F.expr(KEY), gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every remaining document the mix takes."""
    with scratch(spark) as tables:
        mixed = written(mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken"), "mixed")
        tables.keep(mixed)
    return mixed


STAGES = [("language id", keep_languages), ("exact dedup", drop_copies), ("near copies", drop_near_copies),
          ("decontamination", drop_contaminated), ("mix", mix_sources)]

#: The language stage is a learned model, which SQL cannot state; the pipeline
#: is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
