"""The corpus pipeline against plain Python, and each stage on odd rows."""

import random

import brute
import corpus_pipeline
import pytest
from tablewright.llm import language_id

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_whole_pipeline(spark, documents):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    left = [r for r in documents if r[1] and any(c.isalpha() for c in r[1])]
    kept = {i for i, keep, _, k, _ in brute.exact_dedup([(r[0], r[1]) for r in left]) if k}
    left = [r for r in left if r[0] in kept]
    kept = {i for i, _, c in brute.jaccard([(r[0], r[1]) for r in left]) if i == c}
    left = [r for r in left if r[0] in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {x[0] for x in brute.decontaminate([(r[0], r[1]) for r in left], items) if x[-1]}
    left = [r for r in left if r[0] not in dirty]
    assert dirty and set(got) == {r[0] for r in left}
    sizes, size_of = {}, {r[0]: len(brute.TOKEN.findall(r[1])) for r in left}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + size_of[r[0]]
    want = brute.targets(sizes)
    for r in left:
        mine = got[r[0]]
        assert (mine["size"], mine["source_size"]) == (size_of[r[0]], sizes[r[3]])
        assert mine["target"] == pytest.approx(want[r[3]]) and mine["taken"] % max(1, mine["size"]) == 0


ODD = [(1, None), (2, ""), (3, "123 !"), (4, "some words of plain text here"), (4, "some words of plain text here"),
       (5, "Some words of plain text here"), (None, "a null id keeps its words"), (6, "word " * 40_000),
       (7, "another text that stands alone"), (8, "some words of plain text"), (None, "some WORDS of plain text here")]


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("empty", [False, True])
def test_stage_on_odd_rows(spark, docs_frame, k, empty):
    name, stage = corpus_pipeline.STAGES[k]
    rows = [] if empty else ODD
    df = docs_frame(rows)
    got = stage(spark, df, SF)
    if k < 4:
        assert got.columns == df.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=repr)
    expected = {
        "language id": [4, 4, 5, 6, 7, 8, None, None], "exact dedup": [2, 3, 5, 6, 7, 8, None],
        "near copies": [1, 2, 3, 4, 4, 6, 7, 8, None], "decontamination": [i for i, _ in ODD], "mix": [i for i, _ in ODD]}
    assert ids == sorted([] if empty else expected[name], key=repr)


def test_rows_that_stand_twice_stay_once(spark, docs_frame):
    got = corpus_pipeline.drop_copies(spark, docs_frame([(1, "a"), (1, "a"), (2, "b"), (1, "c")]), SF)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "a"), (1, "c"), (2, "b")]


def test_columns_may_have_any_name(spark, docs_frame):
    """Extra columns named like what the stages use inside come back unchanged."""
    rows = [(1, "der und das ist die", "de"), (2, "the and of it is", "en"), (3, "the and of it is", "en"), (4, "12"),
            (5, " ".join(f"w{i}" for i in range(60))), (6, " ".join(f"w{i}" for i in range(61)))]
    names = ["score", "langs", "lang_pred", "sha", "document_key", "document", "gone", "slot", "nameless", "text_hash",
             "_text_", "held_out", "n", "class", "again"]
    df = docs_frame(rows, extra=False).selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns and got.exceptAll(df).isEmpty(), name
    assert stage(spark, df, SF).count() == 6


def test_stages_leave_small_tables_only(spark, docs_frame):
    import os
    from tablewright.session import run_dir
    rows = [(i, " ".join(f"w{i}-{j // 2}" for j in range(30))) for i in range(40)]
    before = set(os.listdir(run_dir(spark).replace("file://", ""))) if os.path.exists(run_dir(spark)) else set()
    corpus_pipeline.drop_near_copies(spark, docs_frame(rows), SF).count()
    corpus_pipeline.drop_contaminated(spark, docs_frame(rows), SF).count()
    left = set(os.listdir(run_dir(spark))) - before
    assert {x.rsplit("-", 1)[0] for x in left} == {"gone"}
