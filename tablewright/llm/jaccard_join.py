r"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

Documents are the sets of their distinct 5-word shingles (a shorter text is
one shingle); two link when 100 * intersection >= 80 * union. Equal sets form
one class, so copies are never compared. The join:

1. A prefix of each set, its ``n - ceil(0.8 n) + 1`` rarest shingles, must
   meet the prefix of every set it links with. Rarity is read off a corpus
   sketch of fixed size (any common order gives the same links; the sketch
   only keeps frequent shingles out of the prefixes).
2. Shingles that the prefixes of two classes share gather the classes of a size
   band, the bands being a factor 1.25 wide, so a set meets its own and the next
   band only; a class that no other of its bands shares a prefix shingle with is
   done. All such gatherings with the same smallest class, their head, make
   one tile: (head, size band). Tiles hold each class once, however many
   shingles it shares.
3. Every class of a tile is first paired with its head (linear in the tile).
   Links found that way merge classes into groups.
4. Bit counts of hashed bitmap signatures, eight bits a shingle, bound each
   pair's overlap from above. With the head, survivors get the exact intersection
   of their sorted shingle hashes.
5. Of the other pairs of a tile, the bounds tell which classes may link with
   another, block by block, with blocks of bounded size dealt to different tasks.
   These classes get their shingles, and every pair of them is compared exactly,
   in the tile of its smallest common head. Tasks return a number of links per
   class and links that connect groups, fewer than classes, so a group of
   thousands of near copies is compared in full and makes no row per pair. Where
   no links are counted, pairs that are connected already are left out.

The result is connected components over all links, and every class's number
of links. Words: A-Z lower-cased, `[^\x20\x09-\x0D]+`. Shingles and
classes are compared by 64-bit hashes.

Defined cases: null, empty and wordless texts have the empty set and their own
component; repeated rows share a class; a null doc_id takes part but is a
component's id only where all of it are null; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NOT_SPACE, mix, run_hashes, seed, slices, span_hashes, word_spans
from .store import passes, scratch, token_filter, written

SHINGLE = 5
PERCENT = 80
#: Buckets of the rarity sketch (2**20 counters of 4 bytes), in slices.
SKETCH_BITS = 20
SLICES = 64
#: Classes of one block of a tile, and their shingles (32 MB).
BLOCK = 2048
BLOCK_SHINGLES = 1 << 22
#: Bits of a signature per shingle (rounded up to a power of two), and at least.
BITS_PER_SHINGLE = 8
LEAST_BITS = 256


def shingle_sets(batch_text, shingle: int = SHINGLE):
    """Per row of a text column: the sorted distinct shingle hashes."""
    for lo, hi, buf, off in slices(batch_text):
        starts, ends, first = word_spans(buf, off, NOT_SPACE)
        words = span_hashes(buf, starts, ends)
        runs = run_hashes(words, shingle)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= shingle:
                yield np.unique(runs[a:b - shingle + 1])
            else:
                yield run_hashes(words[a:b], int(b - a)) if b > a else words[:0]


def class_of(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _surveyed(docs: DataFrame, doc_id: str, text: str, shingle: int, bits: int) -> DataFrame:
    """One row per document (``doc_id, n, class``), and per task the slices of
    its shingle counts (``slice, part, counts``)."""
    def survey(batches):
        counts = np.zeros(1 << bits, np.uint32)
        seen: set[int] = set()
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            ns, classes = [], []
            for s in shingle_sets(b.column(1), shingle):
                c = class_of(s) if len(s) else None
                ns.append(len(s))
                classes.append(c)
                if c is not None and c not in seen:
                    seen.add(c)
                    at, times = np.unique(s >> np.uint64(64 - bits), return_counts=True)
                    counts[at.astype(np.int64)] += times.astype(np.uint32)
            nulls = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()),
                 nulls(len(ns), pa.int32()), nulls(len(ns), pa.binary())],
                names=["doc_id", "n", "class", "slice", "counts"])
        if kind is not None and seen:
            each = counts.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()),
                 pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in each], pa.binary())],
                names=["doc_id", "n", "class", "slice", "counts"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(survey, f"doc_id {kind}, n long, class long, slice int, counts binary")


def _sketch(surveyed: DataFrame, bits: int) -> np.ndarray:
    """Sum of the tasks' counts. Tasks are added up in two steps, streaming,
    and the driver receives 2**bits counters whatever the input."""
    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c, np.uint32)
                sums[k] = np.maximum(sums[k] + c, np.where(sums[k] > ~c, ~np.uint32(0), 0)) if k in sums else c
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array(list(sums), pa.int32()),
                 "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = surveyed.where("slice is not null").select("slice", "counts")
    parts = (parts.repartition("slice", F.pmod(F.hash("counts"), F.lit(SLICES))).mapInArrow(added, parts.schema)
             .repartition("slice").mapInArrow(added, parts.schema))
    table = np.zeros((SLICES, (1 << bits) // SLICES), np.uint32)
    for r in parts.toLocalIterator():
        table[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return table.ravel()


def prefix_tokens(s: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The necessary prefix of a set as tokens: rarity above hash, so equal
    shingles have equal tokens and tokens sort by rarity."""
    bits = len(sketch).bit_length() - 1
    n = len(s)
    size = n - (percent * n + 99) // 100 + 1
    count = sketch[(s >> np.uint64(64 - bits)).astype(np.int64)]
    rarity = (7.5 * np.log2(1.0 + count)).astype(np.uint64)  # eight bits, finer than a tenth of the count
    tokens = (rarity << np.uint64(56)) | (mix(s) >> np.uint64(8))
    return np.partition(tokens, size - 1)[:size] if size < n else tokens


def signature(s: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set: a power of two of bits, at least LEAST_BITS."""
    bits = max(LEAST_BITS, 1 << int(BITS_PER_SHINGLE * len(s) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(mix(s) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little")


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    """The signature that ``size`` bytes would have held."""
    return np.bitwise_or.reduce(sig.reshape(-1, size), axis=0)


def _each_class(text_column, shingle: int, seen: set):
    for s in shingle_sets(text_column, shingle):
        if len(s):
            c = class_of(s)
            if c not in seen:
                seen.add(c)
                yield c, s


def band_of(n: int, percent: int) -> int:
    """Size band of a set: linked sets stand in one band or in neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))


def gatherings(s: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(keys in the own band, keys in the next, own band)``: a key stands for
    a prefix token and a band."""
    tokens, band = np.unique(prefix_tokens(s, sketch, percent)), band_of(len(s), percent)
    return seed(tokens, band), seed(tokens, band + 1), band


def _shared_keys(docs: DataFrame, text: str, shingle: int, sketch, percent: int) -> DataFrame:
    """Keys that at least two classes have."""
    def listed(batches):
        seen: set[int] = set()
        for b in batches:
            keys, classes, size = [], [], 0
            for c, s in _each_class(b.column(0), shingle, seen):
                keys += gatherings(s, sketch.value, percent)[:2]
                classes.append(np.full(2 * len(keys[-1]), c, np.int64))
                size += len(classes[-1])
                if size > 200_000:
                    yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys).view(np.int64),
                                                      "class": np.concatenate(classes)})
                    keys, classes, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys).view(np.int64),
                                                  "class": np.concatenate(classes)})

    return (docs.select(F.col(text)).mapInArrow(listed, "key long, class long")
            .groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
            .where("lo < hi").select("key"))


def _candidate_classes(docs: DataFrame, text: str, shingle: int, sketch, table, percent: int) -> DataFrame:
    """Classes with a shared key: ``(class, n, band, home, guest, sig,
    shingles)``, the keys in the own band and in the next."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    names = ["class", "n", "band", "home", "guest", "sig", "shingles"]

    def listed(batches):
        seen: set[int] = set()

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            rows, size = [], 0
            for c, s in _each_class(b.column(0), shingle, seen):
                home, guest, band = gatherings(s, sketch.value, percent)
                home, guest = home[passes(table.value, home)], guest[passes(table.value, guest)]
                if len(home) or len(guest):
                    rows.append((c, len(s), band, home.view(np.int64), guest.view(np.int64), signature(s).tobytes(),
                                 s.tobytes()))
                    size += len(s)
                    if size > 250_000:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)

    return docs.select(F.col(text)).mapInArrow(
        listed, "class long, n long, band int, home array<long>, guest array<long>, sig binary, shingles binary")


def overlap_bound(na, nb, sa: np.ndarray, sb: np.ndarray):
    """Upper bound of the overlap: bits that only one signature has stand for
    at least so many elements that only one set has."""
    odd = np.bitwise_count(sa ^ sb).sum(axis=-1, dtype=np.int64)
    return np.minimum((na + nb - odd) // 2, np.minimum(na, nb))


def enough(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link: signatures first, then sorted arrays.
    ``classes`` has a row per class, ``sets`` the arrays, copies included."""
    def bounded(batches):
        for b in batches:
            ok = []
            for na, nb, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                ok.append(bool(enough(overlap_bound(na, nb, fold(x, size), fold(y, size)), na, nb, percent)))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long, short)
                same = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                keep.append(enough(same, len(x), len(y), percent))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    def wanted(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield b.filter(pa.array(passes(table.value, h)))

    small = classes.select("class", "n", "sig")
    a, b = ({c: f"{c}_{k}" for c in ("n", "sig", "shingles")} for k in "ab")
    near = (pairs.join(small.withColumnsRenamed(a).withColumnRenamed("class", "a"), "a")
            .join(small.withColumnsRenamed(b).withColumnRenamed("class", "b"), "b")
            .select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(bounded, "a long, b long"))
    near = written(near, "jaccard-near")
    # Only the sets of pairs that passed the bound are moved.
    ends = near.selectExpr("explode(array(a, b)) as class").distinct()
    table = pairs.sparkSession.sparkContext.broadcast(token_filter(ends, "class"))
    whole = sets.select("class", "shingles")
    whole = written(whole.mapInArrow(wanted, whole.schema).dropDuplicates(["class"]), "jaccard-whole")
    return (near.join(whole.withColumnsRenamed(a).withColumnRenamed("class", "a"), "a")
            .join(whole.withColumnsRenamed(b).withColumnRenamed("class", "b"), "b")
            .select("a", "b", "shingles_a", "shingles_b").mapInArrow(exact, "a long, b long"))


def _held(batches):
    """``(key, rows)`` of batches sorted by their first four columns; ``rows``
    are tuples of the other columns. Blocks are bounded, so a task holds two
    at a time."""
    held: list = []
    key = None
    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns)):
            if row[:4] != key:
                if held:
                    yield key, held
                held, key = [], row[:4]
            held.append(row[4:])
    if held:
        yield key, held


def _block_pairs(tiles: DataFrame, columns: list[str]) -> DataFrame:
    return (tiles.repartition("head", "band", "i", "j").sortWithinPartitions("head", "band", "i", "j", "class")
            .select("head", "band", "i", "j", *columns))


def _flagged(tiles: DataFrame, percent: int, counts: bool) -> DataFrame:
    """Of a tile's block pair: each ``class`` of a pair without the head whose
    bounds allow a link; unless ``counts``, of a pair in different groups."""
    def candidates(key, held):
        c, g, n, home, block = (np.array(x) for x in zip(*[r[:5] for r in held]))
        size = min(len(r[5]) for r in held)
        sig = np.stack([fold(np.frombuffer(r[5], np.uint8), size) for r in held])
        may = np.zeros(len(c), bool)
        left, right = np.flatnonzero((block == key[2]) & (c != key[0])), np.flatnonzero((block == key[3]) & (c != key[0]))
        for i in left:
            r = right[right > i] if key[2] == key[3] else right
            wanted = ~(may[r] & may[i]) & (home[r] | home[i])
            r = r[wanted if counts else wanted & (g[r] != g[i])]
            r = r[100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i])]
            r = r[enough(overlap_bound(n[r], n[i], sig[r], sig[i]), n[r], n[i], percent)]
            if len(r):
                may[r] = may[i] = True
        return c[may]

    def flagged(batches):
        for key, held in _held(batches):
            c = candidates(key, held)
            if len(c):
                tile = zip(("head", "band", "i", "j"), key, (pa.int64(), *[pa.int32()] * 3))
                yield pa.RecordBatch.from_pydict({x: pa.array([v] * len(c), k) for x, v, k in tile}
                                                 | {"class": pa.array(c, pa.int64())})

    return (_block_pairs(tiles, ["class", "group", "n", "home", "block", "sig"])
            .mapInArrow(flagged, "head long, band int, i int, j int, class long"))


def _intersected(tiles: DataFrame, percent: int, counts: bool) -> DataFrame:
    """Links within a tile's block pair by exact intersection, but for those
    ``linked`` already (the smaller classes of known links) and those of a
    smaller common head: rows ``(class, other)`` of links that connect groups,
    fewer than the block pair has classes, and, if ``counts``, ``(class, n_links)``
    over all. Without ``counts``, pairs that are connected are not compared."""
    def links(key, held):
        head, _, i_block, j_block = key
        c, g, home, block = (np.array(x) for x in zip(*[r[:4] for r in held]))
        sets = [np.frombuffer(r[6], np.uint64) for r in held]
        n = np.array([len(x) for x in sets])
        sigs = [signature(x) for x in sets]
        size = min(len(x) for x in sigs)
        sig = np.stack([fold(x, size) for x in sigs])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.split(at.astype(np.int32), np.cumsum(n)[:-1])
        mark = np.zeros(1 + max(int(x.max()) for x in at), np.uint8)
        place = {x: k for k, x in enumerate(c.tolist())}
        elsewhere: dict = {}  # smaller head -> its classes here
        known: dict = {}  # class -> classes here that link with it
        for k, r in enumerate(held):
            for x in r[4]:
                if x < head:
                    elsewhere.setdefault(x, []).append(k)
            for x in r[5] or ():
                if x in place:
                    known.setdefault(place[x], []).append(k)
                    known.setdefault(k, []).append(place[x])
        elsewhere = {x: np.array(k) for x, k in elsewhere.items() if len(k) > 1}
        degree = np.zeros(len(c), np.int64)
        g, found = g.copy(), []
        left, right = np.flatnonzero((block == i_block) & (c != head)), np.flatnonzero((block == j_block) & (c != head))
        for i in left:
            r = right[right > i] if i_block == j_block else right
            here = home | home[i]
            for x in held[i][4]:
                if x in elsewhere:
                    here[elsewhere[x]] = False
            here[known.get(i, [])] = False
            r = r[here[r] if counts else here[r] & (g[r] != g[i])]
            r = r[100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i])]
            r = r[enough(overlap_bound(n[r], n[i], sig[r], sig[i]), n[r], n[i], percent)]
            mark[at[i]] = 1
            for r in np.split(r, range(256, len(r), 256)):
                if len(r):
                    same = np.add.reduceat(mark[np.concatenate([at[k] for k in r])],
                                           np.cumsum(n[r]) - n[r], dtype=np.int64)
                    r = r[enough(same, n[r], n[i], percent)]
                    degree[r] += 1
                    degree[i] += len(r)
                    for k in r[g[r] != g[i]]:
                        if g[k] != g[i]:
                            found.append((min(c[k], c[i]), max(c[k], c[i])))
                            g[g == g[k]] = g[i]
            mark[at[i]] = 0
        return c[degree > 0], degree[degree > 0], found

    def compared(batches):
        for key, held in _held(batches):
            c, degree, found = links(key, held)
            if counts and len(c):
                yield pa.RecordBatch.from_pydict({"class": pa.array(c, pa.int64()), "other": pa.nulls(len(c), pa.int64()),
                                                  "n_links": pa.array(degree, pa.int64())})
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_pydict({"class": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()),
                                                  "n_links": pa.nulls(len(a), pa.int64())})

    return (_block_pairs(tiles, ["class", "group", "home", "block", "heads", "linked", "shingles"])
            .mapInArrow(compared, "class long, other long, n_links long"))


def _further(flags: DataFrame, dealt: DataFrame, first: DataFrame, sets: DataFrame, percent: int,
             counts: bool) -> DataFrame:
    """What :func:`_intersected` finds among the flagged classes; ``first`` are the
    verified pairs with tiles' heads."""
    heads = flags.groupBy("class", "band").agg(F.collect_set("head").alias("heads"))
    heads = heads.join(first.groupBy("b").agg(F.collect_set("a").alias("linked")), F.col("class") == F.col("b"), "left")
    heads = written(heads.select("class", "band", "heads", "linked"), "jaccard-met")
    table = flags.sparkSession.sparkContext.broadcast(token_filter(heads, "class"))

    def wanted(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield b.filter(pa.array(passes(table.value, h)))

    whole = sets.select("class", "shingles")
    whole = written(whole.mapInArrow(wanted, whole.schema).dropDuplicates(["class"]), "jaccard-compared")
    held = (flags.join(dealt, ["head", "band", "i", "j", "class"]).join(heads, ["class", "band"])
            .join(whole, "class"))
    return written(_intersected(held, percent, counts), "jaccard-further")


def _link_counts(further: DataFrame, first: DataFrame) -> DataFrame:
    """``(class, n_links)`` over all links: those with tiles' heads and the others."""
    ends = first.select(F.explode(F.array("a", "b")).alias("class"), F.lit(1).cast("long").alias("n_links"))
    inside = further.where("n_links is not null").select("class", "n_links")
    return written(inside.unionByName(ends).groupBy("class").agg(F.sum("n_links").alias("n_links")),
                   "jaccard-counts")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``links (a, b)``.

    Every round each node takes the smallest label among its neighbours' and
    its label's label (pointer jumping), so paths halve; a round ends in a
    written table. Minimum aggregates combine before the shuffle, so a node
    with very many links costs one row per task."""
    both = written(links.unionByName(links.selectExpr("b as a", "a as b")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
                     .withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
                .withColumnRenamed("a", "node"))
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.selectExpr("node as label", "label as further")
        step = written(step.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = not step.where("label != old").isEmpty()
        labels = step.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 percent: int = PERCENT, sketch_bits: int = SKETCH_BITS,
                 block: int = BLOCK, counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: members has ``(doc_id, n_shingles, class,
    component_id, n_links)`` for every row, ``n_links`` being the number of
    other classes that its class links with; links has the verified pairs of
    classes that connect the components (a spanning set: pairs already
    connected may be left out). Without ``counts``, for who needs components
    only, there is no ``n_links``."""
    with scratch(docs.sparkSession) as tables:
        return _joined(docs, doc_id, text, shingle, percent, sketch_bits, block, counts, tables)


def _joined(docs, doc_id, text, shingle, percent, sketch_bits, block, counts, tables) -> tuple[DataFrame, DataFrame]:
    sc = docs.sparkSession.sparkContext
    surveyed = written(_surveyed(docs, doc_id, text, shingle, sketch_bits), "jaccard-survey")
    sketch = sc.broadcast(_sketch(surveyed, sketch_bits))
    shared = written(_shared_keys(docs, text, shingle, sketch, percent), "jaccard-keys")
    table = sc.broadcast(token_filter(shared, "key"))
    sets = written(_candidate_classes(docs, text, shingle, sketch, table, percent), "jaccard-sets")
    classes = written(sets.select("class", "n", "band", "home", "guest", "sig").dropDuplicates(["class"]),
                      "jaccard-classes")

    # Tiles: a class is at home in its own size band and a guest in the next.
    posts = classes.select("class", "n", "band", F.lit(True).alias("home"), F.explode("home").alias("key")).unionByName(
        classes.select("class", "n", (F.col("band") + 1).alias("band"), F.lit(False).alias("home"),
                       F.explode("guest").alias("key")))
    posts = written(posts.join(shared, "key"), "jaccard-posts")
    heads = posts.groupBy("key", "band").agg(F.min("class").alias("head"), F.max("class").alias("last"))
    heads = written(heads.where("head < last").select("key", "band", "head"), "jaccard-heads")
    tiles = written(posts.join(heads, ["key", "band"]).select("head", "band", "home", "class", "n").distinct(),
                    "jaccard-tiles")
    first = tiles.where("class != head").selectExpr("head as a", "class as b").distinct()
    links = first_links = written(_verified(first, classes, sets, percent), "jaccard-links")

    merged = written(components(links), "jaccard-groups")
    grouped = tiles.join(merged, tiles["class"] == merged["node"], "left").select(
        "head", "band", "home", "class", "n", F.coalesce("component", "class").alias("group"))
    grouped = written(grouped, "jaccard-grouped")
    # Pairs with the head are done; a tile of two classes has no other.
    open_tiles = (grouped.groupBy("head", "band")
                  .agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("size"),
                       F.sum("n").alias("shingles"))
                  .where("size > 2" if counts else "size > 2 and lo < hi")
                  .select("head", "band", F.ceil(F.greatest(F.col("size") / block, F.col("shingles") / BLOCK_SHINGLES))
                          .cast("int").alias("blocks")))
    open_tiles = written(open_tiles, "jaccard-open")
    dealt = (grouped.join(open_tiles, ["head", "band"])
             .withColumn("block", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("head", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "class", "group", "n", "home", "block"))
    flags = written(_flagged(dealt.join(classes.select("class", "sig"), "class"), percent, counts), "jaccard-flags")
    further = _further(flags, dealt.select("head", "band", "i", "j", "class", "group", "home", "block"), links, sets,
                       percent, counts)
    more = written(further.where("other is not null").selectExpr("class as a", "other as b").distinct(),
                   "jaccard-more")
    counted = _link_counts(further, links) if counts else None
    links = links.unionByName(more)

    joined = components(links)
    rows = surveyed.where("slice is null").select("doc_id", "n", "class")
    lowest = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(joined.withColumnRenamed("node", "class"), "class", "left").select(
        "class", F.coalesce("component", "class").alias("component"), "low")
    lowest = written(lowest, "jaccard-lowest")
    ids = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = lowest.join(written(ids, "jaccard-ids"), "component")
    n_links = []
    if counts:
        ids = ids.join(counted, "class", "left")
        n_links = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")]
    ids = written(ids.select(F.col("class").alias("of_class"), "component_id", *n_links), "jaccard-components")
    members = rows.join(ids, rows["class"] == ids["of_class"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class",
        F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("doc_id"))).alias("component_id"), *n_links)
    tables.keep(surveyed, ids, first_links, more)
    return members, links
