"""Exact dedup, decontamination and the Jaccard join against brute force."""

import random

import pytest

import brute
from tablewright.llm import decontaminate, exact_dedup, jaccard_join
from tablewright.llm.jaccard_join import components

VOCABULARY = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "日本", "a", "the", "of"]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, base = [], [words(rng, rng.randint(20, 120)) for _ in range(25)]
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 18))):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(w) if rng.random() < .8 else "\n".join(w).upper()))
    rows += [(200, None), (201, ""), (202, None), (203, " \t\r\n"), (204, "one"), (205, "ONE"), (206, "two words"),
             (207, rows[3][1]), (208, rows[3][1].upper()), (3, rows[3][1]), (None, rows[5][1]), (None, "alone here"),
             (209, "x" * 70_000 + " " + "lorem ipsum " * 5000), (210, "lorem ipsum " * 5000), (211, "!?., ;")]
    return rows


def same(df, columns, expected):
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(expected, key=repr)


DEDUP = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
DECON = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("fingerprint_bytes", [16, 1])
def test_exact_dedup(docs_frame, corpus, fingerprint_bytes):
    # one byte: most fingerprints stand for several chunks, so ordinals decide
    df = exact_dedup.exact_dedup(docs_frame(corpus), fingerprint_bytes=fingerprint_bytes)
    same(df, DEDUP, brute.exact_dedup(corpus))


def test_chunks_rebuild_the_text_and_follow_content():
    import numpy as np
    rng = np.random.default_rng(1)
    text = rng.integers(32, 127, 60_000).astype(np.uint8)
    shifted = np.concatenate([text[:100], rng.integers(32, 127, 7).astype(np.uint8), text[100:]])
    ends, moved = exact_dedup.cut_points(text), exact_dedup.cut_points(shifted)
    assert ends[-1] == len(text) and (np.diff(ends) > 0).all()
    assert len(set((ends + 7).tolist()) & set(moved.tolist())) >= len(ends) - 2
    assert np.diff(np.append(0, exact_dedup.cut_points(np.zeros(200_000, np.uint8)))).max() <= exact_dedup.LONGEST


def test_decontaminate(docs_frame, spark, corpus):
    rng = random.Random(4)
    item = {i: words(rng, rng.choice([1, 3, 8, 13, 14, 30])) for i in range(12)}
    items = [(i, " ".join(w)) for i, w in item.items()] + [(50, None), (51, "..."), (3, " ".join(item[3])), (7, "the of")]
    rows = list(corpus)
    for i in range(40):
        w = words(rng, rng.randint(5, 200))
        at = rng.randrange(len(w) + 1)
        rows.append((300 + i, " ".join(w[:at]) + ", " + "-".join(item[i % 12]).upper() + ". " + " ".join(w[at:])))
    rows.append((400, " ".join(["w1"] * 60)))
    items.append((60, " ".join(["w1"] * 13)))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as words")
    same(decontaminate.decontaminate(docs_frame(rows), bench), DECON, brute.decontaminate(rows, items))


def test_decontaminate_empty_tables(docs_frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(docs_frame([(1, "a b"), (2, None)]), none)
    same(got, DECON, brute.decontaminate([(1, "a b"), (2, None)], []))
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs_frame([]), some).count() == 0


JACCARD = ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("block", [2048, 4])
def test_jaccard_join(docs_frame, corpus, block):
    # blocks of four classes: every larger tile is dealt to several tasks
    members, links = jaccard_join.jaccard_join(docs_frame(corpus), block=block)
    same(members, JACCARD, brute.jaccard(corpus))
    sets = {jaccard_join.class_of(s): set(s.tolist()) for s in jaccard_join.shingle_sets(text_array(corpus)) if len(s)}
    for r in links.collect():
        a, b = sets[r["a"]], sets[r["b"]]
        assert 100 * len(a & b) >= 80 * len(a | b)


def text_array(rows):
    import pyarrow as pa
    return pa.array([t for _, t in rows], pa.string())


def test_jaccard_chain_and_edge_of_threshold(docs_frame):
    # single words apart: sets of 5-word shingles at and just below 80 %
    base = [f"t{i}" for i in range(49)]
    chain = [(i, " ".join(base[:49 - i] + [f"c{i}x{j}" for j in range(i)])) for i in range(0, 12)]
    got, _ = jaccard_join.jaccard_join(docs_frame(chain))
    same(got, JACCARD, brute.jaccard(chain))


def test_jaccard_large_near_copy_group(docs_frame):
    rng = random.Random(9)
    core = words(rng, 200)
    rows = [(i, " ".join(core[:-1] + [f"tail{i}"])) for i in range(300)] + [(999, "quite another text of seven words")]
    got, links = jaccard_join.jaccard_join(docs_frame(rows))
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert set(by.values()) == {0, 999} and by[299] == 0
    assert links.count() < 3 * 300  # not all pairs of the group


def numbers_of_links(rows):
    """{doc_id: number of other shingle sets that link with its own}, by all pairs."""
    sets = [frozenset(brute.shingles(t)) for _, t in rows]
    each = {s for s in sets if s}
    degree = {s: sum(s != x and 100 * len(s & x) >= 80 * len(s | x) for x in each) for s in each}
    return sorted(((i, degree.get(s, 0)) for (i, _), s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize("block", [2048, 4])
def test_jaccard_counts_all_links(docs_frame, corpus, block):
    # groups within groups: pairs meet in tiles of several heads and in two size bands
    rng, rows = random.Random(21), list(corpus)
    for family in range(6):
        core = words(rng, 60)
        for i in range(30):
            w = core[:60 - rng.randint(0, 12)]
            w[rng.randrange(len(w))] = f"x{rng.randrange(4)}"
            rows.append((1000 + 100 * family + i, " ".join(w + words(rng, rng.randint(0, 3)))))
    members, _ = jaccard_join.jaccard_join(docs_frame(rows), block=block)
    same(members, ["doc_id", "n_links"], numbers_of_links(rows))
    same(members, JACCARD, brute.jaccard(rows))


@pytest.mark.parametrize("counts", [True, False])
def test_jaccard_makes_no_row_per_pair(docs_frame, monkeypatch, counts):
    """Copies of one text, a word changed in each: most link with a few others
    and not with their head. Further links are a forest, not a list of pairs."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 60] + [f"own{i}"] + base[i % 60 + 1:])) for i in range(240)]
    sizes, written = {}, jaccard_join.written

    def kept(df, name, *args):
        out = written(df, name, *args)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", kept)
    got, links = jaccard_join.jaccard_join(docs_frame(rows), counts=counts, block=32)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(i, c) for i, _, c in brute.jaccard(rows)}
    assert "jaccard-across" not in sizes and sizes["jaccard-more"] < sizes["jaccard-flags"]
    sets = {jaccard_join.class_of(s): set(s.tolist()) for s in jaccard_join.shingle_sets(text_array(rows))}
    assert all(100 * len(sets[r["a"]] & sets[r["b"]]) >= 80 * len(sets[r["a"]] | sets[r["b"]]) for r in links.collect())
    if counts:
        degree = {k: sum(100 * len(s & t) >= 80 * len(s | t) for j, t in sets.items() if j != k) for k, s in sets.items()}
        assert {r["class"]: r["n_links"] for r in got.collect()} == degree


def test_jaccard_counts_links_of_a_large_group(docs_frame):
    rng = random.Random(9)
    core = words(rng, 200)
    rows = [(i, " ".join(core[:-1] + [f"tail{i}"])) for i in range(300)] + [(999, "quite another text of seven words")]
    members, _ = jaccard_join.jaccard_join(docs_frame(rows), block=64)
    same(members, ["doc_id", "n_links"], [(i, 299) for i in range(300)] + [(999, 0)])


def test_empty_documents(docs_frame):
    assert exact_dedup.exact_dedup(docs_frame([])).count() == 0
    members, links = jaccard_join.jaccard_join(docs_frame([]))
    assert members.count() == 0 and links.count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (100, 300)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
