r"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (an item of
fewer words is one window). A document holds a window only if it holds every
shingle of the window, so the necessary prefix of a window's shingles, once
they are ordered by rarity in the corpus, is its rarest shingle alone. Steps:

1. corpus counts of all benchmark shingles (each task counts its own, so a
   shingle costs one row per task), which order the shingles by rarity;
2. the documents' positions that hold a prefix shingle, found with a filter
   of fixed size, with the words around them;
3. an equi-join on the prefix shingle, the length and positional bounds (the
   window must fit between the text's first and last word) and the exact
   comparison of all words of the window;
4. per document, the union of the verified spans.

Words: A-Z lower-cased, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.

Defined cases: null, empty and wordless texts have 0 words, no items and are
clean; wordless items have no window; repeated rows of either table each
count as themselves (an item listed twice is one item_id); rows with equal or
null doc_ids are judged row by row; an empty benchmark leaves all documents
clean; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, LOWER, raw, run_hashes, slices, span_hashes, word_spans
from .store import passes, token_filter, written

WINDOW = 13
SHINGLE = 5


def _row_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of each word index."""
    return np.searchsorted(first, at, "right") - 1


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text",
            window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(item_id, words, length, offset, shingle)``: one row per window and
    shingle of it; ``words`` is the window's words joined by one blank."""
    def cut(batches):
        for b in batches:
            out: dict[str, list] = {"item": [], "words": [], "length": [], "offset": [], "token": []}
            off, body = raw(b.column(1))
            ids = b.column(0).to_pylist()
            for i in range(len(ids)):
                buf = LOWER[body[off[i]:off[i + 1]]]
                starts, ends, _ = word_spans(buf, np.array([0, len(buf)]), ALNUM)
                if not len(starts):
                    continue
                whole = buf.tobytes()
                ws = [whole[s:e] for s, e in zip(starts, ends)]
                size = min(window, len(ws))
                k = min(shingle, size)
                h = run_hashes(span_hashes(buf, starts, ends), k).view(np.int64).tolist()
                for at in range(len(ws) - size + 1):
                    joined = b" ".join(ws[at:at + size])
                    for o in range(size - k + 1):
                        out["item"].append(ids[i])
                        out["words"].append(joined)
                        out["length"].append(size)
                        out["offset"].append(o)
                        out["token"].append(h[at + o])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item"], b.schema.field(0).type), pa.array(out["words"], pa.binary()),
                 pa.array(out["length"], pa.int32()), pa.array(out["offset"], pa.int32()),
                 pa.array(out["token"], pa.int64())], names=list(out))

    source = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    kind = source.schema["item"].dataType.simpleString()
    return source.mapInArrow(cut, f"item {kind}, words binary, length int, offset int, token long")


def _counts(docs: DataFrame, text: str, table, sizes: list[int]) -> DataFrame:
    """Corpus count of every benchmark shingle (and of the filter's rare
    false hits, which no later join meets)."""
    def counted(batches):
        for b in batches:
            for _, _, buf, off in slices(b.column(0)):
                starts, ends, first = word_spans(buf, off, ALNUM)
                w = span_hashes(buf, starts, ends)
                for k in sizes:
                    h = run_hashes(w, k)
                    at = np.arange(len(h))
                    h = h[passes(table.value, h) & (at + k <= first[1:][_row_of(first, at)])]
                    u, n = np.unique(h, return_counts=True)
                    if len(u):
                        yield pa.RecordBatch.from_pydict({"token": u.view(np.int64), "n": n})

    return (docs.select(F.col(text)).mapInArrow(counted, "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")))


def _candidates(docs: DataFrame, doc_id: str, text: str, table, sizes: list[int],
                reach: int) -> DataFrame:
    """Per row: ``(row, doc_id, n_words, hits)``; a hit is a prefix shingle's
    place: token, word position and the words within ``reach`` of it."""
    def found(batches):
        for b in batches:
            ids = b.column(1)
            for lo, hi, buf, off in slices(b.column(2)):
                starts, ends, first = word_spans(buf, off, ALNUM)
                w = span_hashes(buf, starts, ends)
                n_words = np.diff(first)
                places = []
                for k in sizes:
                    h = run_hashes(w, k)
                    at = np.flatnonzero(passes(table.value, h))
                    row = _row_of(first, at)
                    inside = at + k <= first[row + 1]
                    places.append((row[inside], at[inside], h[at[inside]].view(np.int64)))
                rows, ats, tokens = (np.concatenate(x) for x in zip(*places))
                order = np.lexsort((ats, rows))
                rows, ats, tokens = rows[order], ats[order], tokens[order]
                before = np.maximum(first[rows], ats - reach)
                after = np.minimum(first[rows + 1], ats + reach + 1)
                whole = buf.tobytes()
                around = [b" ".join(whole[starts[j]:ends[j]] for j in range(s, e))
                          for s, e in zip(before.tolist(), after.tolist())]
                hits = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(tokens), pa.array((ats - first[rows]).astype(np.int32)),
                         pa.array((ats - before).astype(np.int32)), pa.array(around, pa.binary())],
                        names=["token", "pos", "lead", "around"]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), ids.slice(lo, hi - lo),
                     pa.array(n_words.astype(np.int64)), hits], names=["row", "doc_id", "n_words", "hits"])

    source = docs.select(F.monotonically_increasing_id().alias("row"),
                         F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        found, f"row long, doc_id {kind}, n_words long, "
               "hits array<struct<token: long, pos: int, lead: int, around: binary>>")


def contaminated_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: ``rows`` has ``(row, doc_id, n_words)`` for every
    input row, ``spans`` the verified occurrences ``(row, start, stop, item)``
    in words, each span once per item that has the window."""
    spark = docs.sparkSession
    cut = written(windows(items, item_id, item_text, window, shingle), "decon-windows")
    # Shingle sizes in use: the window's, and one for each shorter item length.
    sizes = sorted(r.k for r in cut.select(F.least(F.lit(shingle), "length").alias("k")).distinct().collect())
    sizes = sizes or [shingle]
    all_tokens = spark.sparkContext.broadcast(token_filter(cut, "token"))
    counts = _counts(docs, text, all_tokens, sizes)
    # The rarest shingle of each distinct window is its necessary prefix.
    rarest = (cut.select("words", "length", "offset", "token").distinct()
              .join(counts, "token")
              .groupBy("words", "length")
              .agg(F.min(F.struct("n", "token", "offset")).alias("least"), F.count(F.lit(1)).alias("held"))
              # a window with a shingle that no document holds occurs nowhere
              .where(F.col("held") == F.col("length") - F.least(F.lit(shingle), "length") + 1)
              .select("words", "length", "least.token", "least.offset"))
    rarest = written(rarest, "decon-prefixes")
    prefixes = spark.sparkContext.broadcast(token_filter(rarest, "token"))
    rows = written(_candidates(docs, doc_id, text, prefixes, sizes, window), "decon-rows")
    places = rows.select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.*")
    start = F.col("pos") - F.col("offset")
    begin = F.col("lead") - F.col("offset")  # of the window among the words around
    verified = (places.join(rarest, "token")
                .where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
                .withColumn("seen", F.split(F.col("around").cast("string"), " "))
                .where(F.array_join(F.slice("seen", begin + 1, F.col("length")), " ").cast("binary")
                       == F.col("words"))
                .select("row", start.alias("start"), (start + F.col("length")).alias("stop"), "words"))
    of_items = cut.select("words", "item").distinct()
    return rows.select("row", "doc_id", "n_words"), verified.join(of_items, "words").select(
        "row", "start", "stop", "item")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for
    every row: ``n_hit`` words stand in occurrences of a window, and a row
    with any of them is contaminated when they are ``percent`` % of its words
    or more."""
    rows, spans = contaminated_spans(docs, items, doc_id, text, item_id, item_text, window, shingle)
    spans = written(spans, "decon-spans")
    # Words covered: each span adds what reaches beyond the spans before it.
    covered = (spans.select("row", "start", "stop").distinct()
               .selectExpr("row", "start", "stop", "max(stop) over (partition by row order by start, stop "
                           "rows between unbounded preceding and 1 preceding) as reached")
               .selectExpr("row", "greatest(0, stop - greatest(start, coalesce(reached, 0))) as fresh")
               .groupBy("row").agg(F.sum("fresh").alias("n_hit")))
    named = (spans.select("row", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    out = rows.join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"))
