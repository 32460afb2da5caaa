r"""One query per operator of this package, with DuckDB SQL where SQL can
state the same rows. Every query reads its tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (chat_format, decontaminate, exact_dedup, hard_negatives, html_text, jaccard_join, labelled,
               language_id, mixture, quality, toxicity, url_rules, warc, whitening)
from .store import read

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWERED}')"


# ------------------------------------------------------------------ 1 to 4 --

def q_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, d, "documents"))


SQL_EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {_lower('text')} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""


def q_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark"))


_WORDS = rf"regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
              array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s
             FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (n, t)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""


def q_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    members, _ = jaccard_join.jaccard_join(read(spark, d, "documents"))
    return members.select("doc_id", "n_shingles", "component_id", "n_links")


SQL_JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY doc_id),
m AS (SELECT e.a AS doc_id, count(DISTINCT y.k) AS n_links FROM e JOIN k x ON x.doc_id = e.a JOIN k y ON y.doc_id = e.b
      WHERE x.k != y.k GROUP BY e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.low, w.doc_id) AS component_id,
       coalesce(m.n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON r.x = w.doc_id
"""


def q_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(read(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Rounds that the SQL writes out; those in which nothing fits change nothing.
MIX_ROUNDS = 16
_MIX_ROUNDS = ",\n".join(f"""
a{n} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
        FROM l{n - 1} WHERE size <= budget),
s{n} AS (SELECT source, sum(size) AS spent FROM a{n} WHERE upto <= budget GROUP BY source),
l{n} AS (SELECT a.r, a.source, a.size, a.key, a.doc_id, a.budget - coalesce(s.spent, 0) AS budget
        FROM a{n} a LEFT JOIN s{n} s ON a.source IS NOT DISTINCT FROM s.source WHERE a.upto > a.budget)"""
                        for n in range(1, MIX_ROUNDS + 1))
SQL_MIX_SOURCES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('{mixture.SEED}:' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / greatest(0.05, 1 - len(regexp_extract_all(coalesce(text, ''), '[0-9#$%&*|@<>{{}}=_^~+!]'))
                           / CAST(greatest(length(coalesce(text, '')), 1) AS DOUBLE)) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
      FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap, 3 * source_size / CAST(weight AS DOUBLE) AS full_at,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s),
o AS (SELECT *, CAST(total - (sum(cap) OVER w - cap) AS DOUBLE) / CAST(weights - (sum(weight) OVER w - weight) AS DOUBLE) AS level
      FROM f WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
v AS (SELECT coalesce(arg_min(level, full_at) FILTER (WHERE level <= full_at), 'infinity'::DOUBLE) AS level FROM o),
t AS (SELECT source, source_size,
             CASE WHEN full_at <= v.level THEN CAST(cap AS DOUBLE) ELSE weight * v.level END AS target FROM f, v),
e AS (SELECT *, CAST(least(3, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)) AS BIGINT) AS epochs FROM t),
l0 AS (SELECT d.r, d.source, d.size, d.key, d.doc_id, target - epochs * e.source_size AS budget
       FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
{_MIX_ROUNDS},
picked AS ({" UNION ALL ".join(f"SELECT r FROM a{n} WHERE upto <= budget" for n in range(1, MIX_ROUNDS + 1))})
SELECT doc_id, size, e.source_size, target,
       CAST(least(3, epochs + CASE WHEN picked.r IS NULL THEN 0 ELSE 1 END) * size AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN picked ON picked.r = d.r
"""


# ----------------------------------------------------------------- 5 and 6 --

CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def conversation_records(turns: DataFrame) -> DataFrame:
    """``(conv_id, record)``: each conversation as JSON in one of the layouts
    in use, by its turns: a plain exchange as prompt and response, one with a
    system text as instruction, the others as one of two message lists."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return grouped.selectExpr("conv_id", "t", "transform(t, x -> x.role) as r").selectExpr(
        "conv_id",
        """case
        when r = array('user', 'assistant') then to_json(struct(t[0].text as prompt, t[1].text as response))
        when r = array('system', 'user', 'assistant')
          then to_json(struct(t[0].text as system, t[1].text as instruction, t[2].text as output))
        when conv_id % 2 = 0 and forall(r, x -> x in ('system', 'user', 'assistant'))
          then to_json(struct(transform(t, x -> struct(
            case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end as `from`,
            x.text as value)) as conversations))
        else to_json(struct(transform(t, x -> struct(x.role as role, x.text as content)) as messages))
        end as record""")


def q_format_chats(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-1L as conv_id", "id as turn",
                                     "case id when 0 then 'user' else 'assistant' end as role",
                                     f"'{CONTROL_TEXT}' as text")
    chats = chat_format.format_chats(conversation_records(turns.unionByName(more)), "conv_id", "record")
    return chat_format.digests(chats).withColumnRenamed("id", "conv_id")


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
SQL_FORMAT_CHATS = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(12 + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")})
                 + 1 + length({_ESCAPED.format('text')}) + 11) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def q_url_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"select * from values {rows} as t(host, path, verdict)")
    return url_rules.judge_urls(read(spark, d, "pages"), rules)


SQL_URL_RULES = f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT row_number() OVER () AS n, page_id,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWERED}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT n, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict),
                        length(rule_host || rule_path) * 10000 + length(rule_host)) AS best
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN b USING (n)
"""


# ----------------------------------------------------------------- 7 to 10 --

def q_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    usable = language_id.crc_fold("doc_id", 5) != 0
    model = labelled.fitted(labelled.sample(docs, read(spark, d, "labels"), "quality", usable), quality.fit)
    docs = docs.withColumn("held_out", ~usable)
    return quality.score_quality(docs, model, keep=("held_out",))


def q_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    usable = language_id.crc_fold("doc_id", 4) != 2
    model = labelled.fitted(labelled.sample(docs, read(spark, d, "labels"), "toxic", usable), toxicity.fit)
    docs = docs.withColumn("held_out", ~usable)
    return toxicity.score_toxicity(docs, model, keep=("held_out",))


def q_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    held = language_id.crc_fold("doc_id", 4) == 2
    model = language_id.learned(docs, held)
    found = language_id.identify(docs.withColumn("held_out", held), model, keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score", "langs")


def q_warc(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "warc-archives")
    warc.write_archives(read(spark, d, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


# ---------------------------------------------------------------- 11 to 13 --

def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract_text(read(spark, d, "pages"))


# The pages' articles hold headings and paragraphs, with inline marks and line
# breaks, and the references of & and quotes.
SQL_HTML_TEXT = r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url,
                  regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
b AS (SELECT r, unnest(regexp_split_to_array(body, '</?(h1|p)>')) AS block,
             unnest(range(len(regexp_split_to_array(body, '</?(h1|p)>')))) AS pos FROM a),
t AS (SELECT r, pos, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               block, '<br>', ' ', 'g'), '</?[a-z]+>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
               chr(160), ' '), chr(133), ' '), '\s+', ' ', 'g')) AS line FROM b),
j AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS text FROM t WHERE line != '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars
FROM a LEFT JOIN j USING (r)
"""


def q_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read(spark, d, "embeddings"), vector="embedding")


def q_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select(
        "vec_id", "embedding",
        F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end").alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, vector="embedding")


SQL_HARD_NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r != b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.r, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""

QUERIES = {
    "op1_exact_dedup": q_exact_dedup,
    "op2_decontaminate": q_decontaminate,
    "op3_jaccard_join": q_jaccard_join,
    "op4_mix_sources": q_mix_sources,
    "op5_format_chats": q_format_chats,
    "op6_url_rules": q_url_rules,
    "op7_quality": q_quality,
    "op8_toxicity": q_toxicity,
    "op9_language_id": q_language_id,
    "op10_warc": q_warc,
    "op11_html_text": q_html_text,
    "op12_whitening": q_whitening,
    "op13_hard_negatives": q_hard_negatives,
}

ORACLE_SQL = {
    "op1_exact_dedup": SQL_EXACT_DEDUP,
    "op2_decontaminate": SQL_DECONTAMINATE,
    "op3_jaccard_join": SQL_JACCARD_JOIN,
    "op4_mix_sources": SQL_MIX_SOURCES,
    "op5_format_chats": SQL_FORMAT_CHATS,
    "op6_url_rules": SQL_URL_RULES,
    "op10_warc": SQL_WARC,
    "op11_html_text": SQL_HTML_TEXT,
    "op13_hard_negatives": SQL_HARD_NEGATIVES,
}
