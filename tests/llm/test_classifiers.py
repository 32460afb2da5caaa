"""Quality, toxicity and language models: held-out accuracy and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import labelled, language_id, quality, toxicity
from tablewright.llm.arrowtext import slices
from tablewright.llm.registered import QUERIES
from tablewright.llm.store import read

SF = "/root/testdata/sf0.1"


def scored_texts(module, model, texts, lower):
    return np.concatenate([module.scores(b, o, np.frombuffer(model, np.float32))
                           for _, _, b, o in slices(pa.array(texts, pa.string()), lower=lower)])


@pytest.mark.parametrize("name,label,held,least", [
    ("op7_quality", "quality", lambda i: zlib.crc32(str(i).encode()) % 5 == 0, 0.97),
    ("op8_toxicity", "toxic", lambda i: zlib.crc32(str(i).encode()) % 4 == 2, 0.95)])
def test_held_out_accuracy(spark, name, label, held, least):
    got = QUERIES[name](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    known = {r["doc_id"]: r[label] for r in read(spark, SF, "labels").collect()}
    rows = got.collect()
    assert len(rows) == read(spark, SF, "documents").count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    judged = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean([p == y for p, y in judged]) >= least
    for y in (0, 1):
        assert np.mean([p == y for p, k in judged if k == y]) >= 0.9


def test_language_held_out_accuracy(spark):
    rows = QUERIES["op9_language_id"](spark, SF).join(
        read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) >= 0.99


def test_held_out_rows_are_not_learnt(spark, docs_frame):
    ids = [i for i in range(400)]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
    rows = [(i, "der und das ist" if not h else "qqq zzz", "de" if not h else "xx") for i, h in zip(ids, held)]
    names, _ = language_id.learned(docs_frame(rows), language_id.crc_fold("doc_id", 4) == 2)
    assert names == ["de"]


def test_mixture_names_both_languages(spark, docs_frame):
    docs = read(spark, SF, "documents").where("lang in ('de', 'es')").limit(800)
    model = language_id.learned(docs, F.lit(False))
    two = {k: docs.where(F.col("lang") == k).where("length(text) > 1500").first()["text"] for k in ("de", "es")}
    rows = [(1, two["de"][:1200] + " " + two["es"][:700]), (2, two["de"]), (3, two["es"]), (4, None), (5, "12 + 3!"),
            (6, ""), (7, "日本"), (8, "ü"), (9, (two["de"] + " ") * 300), (2, two["de"]), (None, two["es"])]
    got = {}
    for r in language_id.identify(docs_frame(rows), model, keep=("source",)).collect():
        got[r["doc_id"]] = r
    assert got[1]["langs"] == ["de", "es"] and got[1]["lang_pred"] == "de" and got[1]["score"] < 0.9
    assert (got[2]["langs"], got[3]["langs"], got[9]["langs"]) == (["de"], ["es"], ["de"])
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["langs"]) == ("und", 0.0, []) for i in (4, 5, 6))
    assert got[7]["lang_pred"] in ("de", "es") and got[8]["lang_pred"] in ("de", "es")
    assert got[None]["lang_pred"] == "es" and got[2]["source"] == "s"


def test_em_proportions_match_plain_em():
    rng = np.random.default_rng(2)
    logs = np.log(rng.dirichlet(np.ones(1 << language_id.BITS) * 0.2, 3) + 1e-9).astype(np.float32)
    buf = rng.integers(97, 123, 3000).astype(np.uint8)
    off = np.array([0, 5, 5, 1000, 3000])
    rows, _, theta = language_id.infer(language_id.gram_buckets(buf), off, logs)
    assert rows.tolist() == [0, 2, 3]
    at = language_id.gram_buckets(buf)
    for j, i in enumerate(rows):
        stop = language_id.gram_ends(off)[i]
        runs = [logs[:, at[s:min(s + language_id.RUN, stop)]].sum(axis=1).astype(float)
                for s in range(off[i], stop, language_id.RUN)]
        p = np.ones(3) / 3
        for _ in range(language_id.ROUNDS):
            post = np.array([np.exp(r - r.max()) * p for r in runs])
            p = (post / post.sum(axis=1, keepdims=True)).mean(axis=0)
        assert theta[:, j] == pytest.approx(p, abs=1e-6)


def test_no_training_rows(spark, docs_frame):
    docs = docs_frame([(1, "a b", None), (2, None, "en")])
    model = language_id.learned(docs, F.lit(False))
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


EDGE = [(1, None), (2, ""), (3, "word " * 60_000), (4, "one"), (4, "one"), (None, "x y"), (5, " \n")]


@pytest.mark.parametrize("module,score", [(quality, quality.score_quality), (toxicity, toxicity.score_toxicity)])
def test_scores_of_edge_rows(spark, docs_frame, module, score):
    texts = ["good plain words here"] * 20 + ["bad awful vile rot"] * 20
    model = module.fit(texts, [0] * 20 + [1] * 20)
    got = score(docs_frame(EDGE), model, keep=("lang",)).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 5)}
    assert len(empty) == 1
    assert score(docs_frame([]), model).count() == 0
    one_class = module.fit(["a", "b"], [1, 1])
    assert {r["score"] for r in score(docs_frame(EDGE), one_class).collect()} <= {0.0, 0.5}


def test_folded_scores_equal_the_softmax():
    texts = ["### bad&&& line%%%", "a quiet line of words", "more words in a line", "%%% &&& ###"] * 6
    labels = [0, 1, 1, 0] * 6
    rows = quality.distinct_rows(texts)
    vectors, output, bias = quality.train(rows, labels)
    z = np.stack([share @ vectors[at] for at, share in rows]) @ output + bias
    p = np.exp(z[:, 1]) / np.exp(z).sum(axis=1)
    assert scored_texts(quality, quality.fit(texts, labels), texts, False) == pytest.approx(p, abs=1e-4)


def test_counterfactual_term_frees_neutral_mentions():
    rng = random.Random(6)
    plain = ["table", "river", "walk", "music", "bread", "paper", "green", "window"]
    say = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    texts, labels = [], []
    for _ in range(150):  # one group is mentioned in toxic texts only
        texts += [f"{say(6)}. muslims {' '.join(rng.sample(['vermin', 'scum', 'filth'], 2))} {say(3)}. {say(4)}",
                  f"{say(10)}. {say(5)}"]
        labels += [1, 0]
    neutral = [f"{say(4)} muslims muslims {say(4)}" for _ in range(50)]
    toxic = [f"{say(4)} vermin scum {say(4)}" for _ in range(50)]
    free = scored_texts(toxicity, toxicity.fit(texts, labels, pull=0.0), neutral, True)
    held = toxicity.fit(texts, labels)
    pulled = scored_texts(toxicity, held, neutral, True)
    assert pulled.mean() < 0.3 < free.mean()
    assert scored_texts(toxicity, held, toxic, True).mean() > 0.5


def test_sample_is_bounded_and_fair(spark, docs_frame):
    docs = docs_frame([(i, f"text {i}") for i in range(100)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)] + [(1, None), (None, 1), (500, 1)],
                                   "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.col("doc_id") % 2 == 0, most=10).collect()
    assert sum(r["y"] == 0 for r in got) == 10 and 9 <= sum(r["y"] for r in got) <= 10
    assert all(r["doc_id"] % 2 == 0 and r["y"] == int(r["doc_id"] % 3 == 0) for r in got)


def test_language_short_rows_do_not_read_the_next():
    def of_first(texts):
        lo, hi, buf, off = next(iter(slices(pa.array(texts, pa.string()))))
        return int(language_id.gram_buckets(buf, off)[0])

    for text in ("a", "ab", "日", "é"):
        assert len({of_first([text]), of_first([text, "xyz"]), of_first([text, "hello"]), of_first([text, "", "日本"])}) == 1
