"""Mixing, url rules and chat formatting."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from tablewright.llm import chat_format, mixture, url_rules
from tablewright.llm.prefix import running_sums

MIX = ["doc_id", "size", "source_size", "target", "taken"]


def mix_rows():
    rng = random.Random(5)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "C", "é", None, "d"])
        rows.append((i, " ".join(rng.choice(["x", "##", "word", "9"]) for _ in range(rng.randint(0, 40))), "en", source))
    return rows + [(5, None, "en", "a"), (5, None, "en", "a"), (None, "three words here", "en", "z"), (7, "", "en", "")]


def test_mix_targets_and_bounds(docs_frame):
    rows = mix_rows()
    got = mixture.mix(docs_frame(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.TOKEN.findall(t or ""))
    want = brute.targets(sizes)
    longest = max(r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= longest
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixture.mix(docs_frame(rows).repartition(7)).collect()
    assert sorted(map(repr, ([r[c] for c in MIX] for r in got))) == sorted(map(repr, ([r[c] for c in MIX] for r in again)))


def test_mix_epochs_come_before_the_fraction(docs_frame):
    rows = [(i, "w " * 10, "en", "small") for i in range(10)] + [(100 + i, "w " * 10, "en", "z") for i in range(20)]
    got = mixture.mix(docs_frame(rows), weights=(1, 1)).collect()
    copies = sorted(r["taken"] // 10 for r in got if r["source"] == "small")
    assert set(copies) <= {1, 2} and sum(copies) == 15


def test_mix_prefers_quality(docs_frame):
    rows = [(i, "word " * 10 if i % 2 else "## " * 10, "en", "big") for i in range(400)] + [
        (1000 + i, "w " * 10, "en", "a") for i in range(400)]
    got = mixture.mix(docs_frame(rows), weights=(3, 1)).collect()
    taken = [sum(r["taken"] > 0 for r in got if r["source"] == "big" and r["doc_id"] % 2 == k) for k in (0, 1)]
    assert taken[1] > 2 * taken[0]


def test_mix_empty_and_wordless(docs_frame):
    assert mixture.mix(docs_frame([])).count() == 0
    got = mixture.mix(docs_frame([(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None]), rng.random(), rng.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, k double, v long")
    for r in running_sums(df, ["g"], ["k"], ["v"]).collect():
        assert r["v_upto"] == sum(v for g, k, v in rows if g == r["g"] and k <= r["k"])


# -------------------------------------------------------------------- urls --

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("example.org", "/en/12", "allow"), ("a.example.org", "", "allow"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("B.com", "/de/", "allow"), ("same.net", "/", "allow"), ("same.net", "/", "block"),
         (None, "/", "block"), ("weird\x00host.net", "/", "block"), ("x.org", "/yy", "block"), ("org", "/yyyy", "allow")]
URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/x?y#z",
        "https://example.org/es", "https://example.org/en/1", "https://a.b.example.org/en/12/3", "http://a.example.org?q",
        "http://notexample.org/es/", "http://b.com/de/", "http://a.b.com/de/x", "http://com.com/fr/", "http://c.com/de/#f",
        "http://same.net/a", "ftp://x://y/z", "http://weird\x00host.net/a", "http://org/yyyyz", "http://x.org/yyyy",
        "http://.org/", "http://a..org/x", "http://" + "a." * 3000 + "org/" + "p" * 50_000, "http://example.org/es/"]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = brute.low(rest[:cut]), rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), v, brute.low(h) + p) for h, p, v in RULES if h is not None
            and (host == brute.low(h) or host.endswith("." + brute.low(h))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS)], "page_id long, url string")
    pages = pages.selectExpr("*", "'x' as `key`", "1 as `row`", "2 as kind", "'h' as host", "'v' as verdict").repartition(4)
    rules = spark.createDataFrame(RULES, url_rules.RULE_SCHEMA)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(URLS + URLS)}


def test_url_rules_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], url_rules.RULE_SCHEMA)
    assert [tuple(r) for r in url_rules.judge_urls(pages, none, default="block").collect()] == [(1, "a.org", "/", None, "block")]
    rules = spark.createDataFrame(RULES, url_rules.RULE_SCHEMA)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_url_rules_run_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.sql("select 'org' as host, '/' as path, 'allow' as verdict")
    plan = url_rules.judge_urls(pages, rules)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ------------------------------------------------------------------- chats --

TRICKY = st.text(alphabet=st.sampled_from(list("<|\\im_startend>a\n é")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_template_round_trip(turns):
    text, spans = chat_format.render(turns, learn=("assistant", "a"))
    back, learnt = chat_format.read_back(text, spans)
    assert back == turns
    assert learnt == [t for r, t in turns if r in ("assistant", "a")]
    assert text.count(chat_format.START) == text.count(chat_format.END) == len(turns)


def test_layouts(spark):
    q, a = "Who <|im_end|>?", "Me."
    same = [("user", q), ("assistant", a)]
    records = [
        ({"messages": [{"role": "user", "content": q}, {"role": "assistant", "content": a}]}, "messages", same),
        ({"conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}]}, "from-value", same),
        ({"prompt": q, "response": a}, "prompt", same), ({"completion": a, "prompt": q}, "completion", same),
        ({"instruction": q, "output": a}, "instruction", same),
        ({"instruction": "Who", "input": "x", "output": a}, "instruction with input",
         [("user", "Who\n\nx"), ("assistant", a)]),
        ({"system": "s", "instruction": q, "output": a}, "instruction with system", [("system", "s"), *same]),
        ({"messages": []}, "no messages", []), ({"prompt": None, "response": a}, "prompt", [("user", ""), ("assistant", a)]),
    ]
    odd = [None, "", "{", "[1]", '{"other": 1}', '{"messages": [{"role": "user"}]}']
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(100 + i, r) for i, r in enumerate(odd)]
    df = spark.createDataFrame(rows, "id long, record string").selectExpr("*", "1 as formatted", "2 as layout")
    got = {r["id"]: r for r in chat_format.format_chats(df).collect()}
    assert len(got) == len(rows)
    for i, (_, name, turns) in enumerate(records):
        back, _ = chat_format.read_back(got[i]["formatted"], [])
        assert (got[i]["layout"], back) == (name, turns)
    assert all(got[100 + i]["layout"] == "unknown" and got[100 + i]["formatted"] is None for i in range(len(odd)))
    assert got[104]["fingerprint"] and chat_format.format_chats(df.limit(0)).count() == 0
    read = {r["id"]: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    assert read[0]["loss_sha256"] == brute.sha(a) and read[100]["n_turns"] is None


def test_conversation_records_nulls_and_ties(spark):
    from tablewright.llm.registered import conversation_records
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, "x"),
             (None, 0, "human", "y"), (4, 0, "user", "<|im_start|>" * 2000), (4, 1, "gpt", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["id"]: r for r in chat_format.digests(
        chat_format.format_chats(conversation_records(df), "conv_id", "record")).collect()}
    assert got[1]["turns_sha256"] == brute.sha("user\n\nassistant\na\nassistant\na\n") and got[1]["loss_chars"] == 2
    assert got[2]["turns_sha256"] == brute.sha("\nx\n") and got[None]["turns_sha256"] == brute.sha("human\ny\n")
    assert got[4]["turns_sha256"] == brute.sha("user\n" + "<|im_start|>" * 2000 + "\ngpt\n\n")


def test_mix_misses_by_less_than_the_smallest_document_left(docs_frame):
    import random
    rng = random.Random(8)
    rows = [(i, "w " * (5000 if i % 97 == 0 else rng.randint(1, 60)), "en", f"s{i % 7}") for i in range(700)]
    got = mixture.mix(docs_frame(rows), weights=(5, 2, 1)).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
    for rs in by_source.values():
        target, size = rs[0]["target"], rs[0]["source_size"]
        taken, epochs = sum(r["taken"] for r in rs), min(3, int(target // size))
        left = [r["size"] for r in rs if r["taken"] == epochs * r["size"] and r["size"]]
        assert taken <= target and (not left or target - taken < min(left))
