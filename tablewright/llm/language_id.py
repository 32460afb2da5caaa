"""Language identification as multilingual mixture inference.

Training: hashed byte 4-grams of the lower-cased labelled texts are counted
per language over all training rows; smoothed counts are the languages'
n-gram likelihoods. Inference: a document is a mixture of languages. Its
n-grams are taken in runs of ``RUN`` positions, a run's log-likelihood per
language being the sum over its n-grams, and expectation-maximisation
estimates the document's proportions. The language set is then the one of the
largest penalised likelihood among the sets of the 1, 2, ... largest
proportions (log-likelihood less ``penalty`` log(runs) / 2 per further
language); the prediction is the set's largest member.

Model size: languages x 2**BITS counters, whatever the corpus.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and an empty set; texts shorter than an n-gram are one n-gram; languages with
equal likelihood go by name; null languages are not learned; without any
training row every text is ``und``; repeated rows count as often as they
stand; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import eights, slices
from .store import written

GRAM = 4
BITS = 15
SLICES = 16
RUN = 32
ROUNDS = 12
PENALTY = 6.0
SMOOTH = 0.1
UNKNOWN = "und"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(buf: np.ndarray, off: np.ndarray | None = None, gram: int = GRAM, bits: int = BITS) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte; with the rows' offsets, a
    row shorter than an n-gram is its own bytes, without those of the next."""
    values = eights(buf)[:len(buf)] & np.uint64((1 << (8 * gram)) - 1)
    if off is not None:
        size = np.diff(off)
        short = (size > 0) & (size < gram)
        values[off[:-1][short]] &= (np.uint64(1) << (8 * size[short]).astype(np.uint64)) - np.uint64(1)
    return ((values * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int32)


def gram_ends(off: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """End of each row's n-gram starts; a shorter row has one."""
    size = np.diff(off)
    return off[:-1] + np.where(size > 0, np.maximum(size - gram + 1, 1), 0)


def train_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, slice, counts)``: n-gram counters of all rows with a language.
    Every task adds up its rows; the tasks' counters are added in two
    streaming steps, so no task holds more than its slices."""
    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi, buf, off in slices(b.column(0)):
                at, stop = gram_buckets(buf, off), gram_ends(off)
                for i, name in enumerate(b.column(1).slice(lo, hi - lo).to_pylist()):
                    sums.setdefault(name, np.zeros(1 << BITS, np.int64))
                    mine = at[off[i]:stop[i]]
                    sums[name] += np.bincount(mine, minlength=1 << BITS) if len(mine) else 0
        for name, counts in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * SLICES, pa.string()), "slice": pa.array(range(SLICES), pa.int32()),
                 "counts": pa.array([x.tobytes() for x in counts.reshape(SLICES, -1)], pa.binary())})

    def added(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for name, k, c in zip(*(x.to_pylist() for x in b.columns)):
                c = np.frombuffer(c, np.int64)
                sums[name, k] = sums[name, k] + c if (name, k) in sums else c
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([x[0] for x in sums], pa.string()), "slice": pa.array([x[1] for x in sums], pa.int32()),
                 "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = parts.mapInArrow(counted, "lang string, slice int, counts binary")
    return (parts.repartition("lang", "slice", F.pmod(F.hash("counts"), F.lit(8))).mapInArrow(added, parts.schema)
            .repartition("lang", "slice").mapInArrow(added, parts.schema))


def likelihoods(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """``(languages, log-likelihoods [language, bucket])``."""
    sums: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator():
        table = sums.setdefault(r["lang"], np.zeros((SLICES, (1 << BITS) // SLICES), np.int64))
        table[r["slice"]] += np.frombuffer(bytes(r["counts"]), np.int64)
    names = sorted(sums)
    if not names:
        return [], np.zeros((0, 1 << BITS), np.float32)
    counts = np.stack([sums[n].ravel() for n in names]) + SMOOTH
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=0, keepdims=True))
    return x / x.sum(axis=0, keepdims=True)


def _mixture(runs: np.ndarray, first: np.ndarray, row: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS):
    """EM over rows: ``runs`` [language, run], ``first`` run of each row,
    ``row`` of each run, ``allowed`` [language, row]. Returns proportions
    [language, row] and the log-likelihood of each row."""
    theta = allowed / allowed.sum(axis=0, keepdims=True)
    size = np.bincount(row, minlength=len(first)).astype(np.float64)
    top = runs.max(axis=0)
    like = np.exp(runs - top)
    for _ in range(rounds):
        share = like * theta[:, row]
        share /= np.maximum(share.sum(axis=0, keepdims=True), 1e-300)
        theta = np.add.reduceat(share, first, axis=1) / size
    total = np.log(np.maximum((like * theta[:, row]).sum(axis=0), 1e-300)) + top
    return theta, np.add.reduceat(total, first)


def infer(buckets: np.ndarray, off: np.ndarray, logs: np.ndarray, penalty: float = PENALTY):
    """Per row with n-grams: ``(rows, chosen [language, row], proportions)``."""
    stop = gram_ends(off)
    rows = np.flatnonzero(stop > off[:-1])
    if not len(rows):
        return rows, None, None
    n_runs = (stop[rows] - off[rows] + RUN - 1) // RUN
    first = np.concatenate([[0], np.cumsum(n_runs)[:-1]])
    row = np.repeat(np.arange(len(rows)), n_runs)
    begin = off[rows][row] + (np.arange(len(row)) - first[row]) * RUN
    end = np.minimum(begin + RUN, stop[rows][row])
    edges = np.stack([begin, end], 1).ravel()
    runs = np.stack([np.add.reduceat(np.append(table[buckets], np.float32(0)), edges)[::2] for table in logs])
    runs = runs.astype(np.float64)
    k = len(logs)
    theta, _ = _mixture(runs, first, row, np.ones((k, len(rows))))
    order = np.argsort(-theta, axis=0, kind="stable")
    alone = np.add.reduceat(runs, first, axis=1)
    best = alone.max(axis=0)
    chosen = np.zeros((k, len(rows)))
    chosen[alone.argmax(axis=0), np.arange(len(rows))] = 1
    share = chosen.copy()
    cost = penalty * np.log(n_runs + 1.0) / 2
    for size in range(2, k + 1):
        allowed = np.zeros((k, len(rows)))
        np.put_along_axis(allowed, order[:size], 1, axis=0)
        part, total = _mixture(runs, first, row, allowed, 6)
        better = total - (size - 1) * cost > best
        if not better.any():
            break
        best = np.where(better, total - (size - 1) * cost, best)
        chosen[:, better], share[:, better] = allowed[:, better], part[:, better]
    return rows, share * chosen, theta


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id",
             text: str = "text", keep: tuple[str, ...] = (), penalty: float = PENALTY) -> DataFrame:
    """``(doc_id, *keep, lang_pred, score, langs)`` for every row; ``langs``
    is the chosen language set and ``score`` the prediction's proportion when
    all languages take part."""
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    letters = np.zeros(256, bool)
    letters[97:123] = True

    def predicted(batches):
        logs = shared.value
        for b in batches:
            ids = b.column(0)
            for lo, hi, buf, off in slices(b.column(1)):
                n = hi - lo
                pred, score, langs = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                ascii_letters = np.concatenate([[0], np.cumsum(letters[buf])])
                plain = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
                if names:
                    rows, share, theta = infer(gram_buckets(buf, off), off, logs, penalty)
                    for j, i in enumerate(rows.tolist()):
                        if plain[i] or has_letter(buf[off[i]:off[i + 1]].tobytes()):
                            at = int(share[:, j].argmax())
                            pred[i], score[i] = names[at], min(1.0, float(theta[at, j]))
                            langs[i] = [names[x] for x in np.flatnonzero(share[:, j] > 0)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), *(b.column(2 + x).slice(lo, n) for x in range(len(keep))),
                     pa.array(pred, pa.string()), pa.array(score), pa.array(langs, pa.list_(pa.string()))],
                    names=["doc_id", *keep, "lang_pred", "score", "langs"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text_"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text_")
    return source.mapInArrow(predicted, f"{fields}, lang_pred string, score double, langs array<string>")


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of a column's text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def learned(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang"):
    """The model of all rows that are not held out."""
    return likelihoods(written(train_counts(docs.where(~held_out), text, lang), "lang-counts"))
