"""URL filters as a sort-merge range join of reversed-host keys. DataFrame and
SQL functions only.

A url's key is its host with the labels reversed, a zero character and its
path: ``a.b.org/x/y`` becomes ``org.b.a\\0/x/y``. A rule for a host and all its
subdomains is looked up under every trailing part of the host (as many as the
longest rule host has labels), so a rule ``host, path`` holds exactly the keys
from ``reversed host \\0 path`` up to its last extension: an interval. Such
intervals are nested or apart.

Keys and interval starts are sorted together, dealt by range, so that a hot
host is spread over tasks by path and page. Every interval start carries the
stack of rules that are open there (itself first, then those it is nested in);
the sweep hands each key the stack of the last start before it, and the first
rule of the stack that still holds the key is the innermost. The last start
before each task's range is handed in as one row per task.

Of the rules that fit a url, the longest ``host + path`` wins; of equally long
ones the longer host, then block. If none fits, the verdict is ``default``.

Defined cases: null urls and urls without ``://`` have empty host and path and
fit no rule; repeated pages are judged each by itself; equal rules with both
verdicts block; null rules are left out; without rules every url gets the
default; an empty table gives an empty result; further columns are kept out of
the keys and not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

RULE_SCHEMA = "host string, path string, verdict string"

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_parts(url: str = "url") -> tuple[str, str]:
    """SQL of a url's host and path: what stands after the first ``://`` up to
    ``/ ? #`` or the end, lower-cased A-Z, and from there up to ``? #``."""
    rest = f"case when instr(`{url}`, '://') > 0 then substring(`{url}`, instr(`{url}`, '://') + 3) else '' end"
    host = ASCII_LOWER.format(f"regexp_extract({rest}, '^[^/?#]*', 0)")
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return host, path


def _key(labels: str, path: str) -> str:
    """Reversed labels, a zero character, the path. A zero inside a host is
    followed by a one, so the zero that ends the host stands alone."""
    return (f"concat(replace(array_join({labels}, '.'), char(0), concat(char(0), char(1))), "
            f"char(0), char(2), {path})")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``(start, stack)`` per distinct rule: its key, and the rules open there
    from the innermost outwards as ``(key, host, path, verdict)``."""
    lower = ASCII_LOWER.format("host")
    own = (rules.where("host is not null and path is not null and verdict is not null")
           .selectExpr(f"{lower} as host", "path", "verdict")
           .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
           .withColumn("key", F.expr(_key("reverse(split(host, '[.]'))", "path"))))
    own = written(own, "url-rules")
    # Enclosing rules are those whose key is a beginning of this one's.
    begins = own.select(F.col("key").alias("start"),
                        F.explode(F.expr("transform(sequence(1, length(key)), n -> substring(key, 1, n))")).alias("key"))
    return (begins.join(own, "key").groupBy("start")
            .agg(F.expr("sort_array(collect_list(struct(length(key) as size, key, host, path, verdict)), false)")
                 .alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``."""
    host, path = url_parts(url)
    starts = written(rule_stacks(rules), "url-stacks")
    # Longer host tails or paths than any rule has cannot change what fits.
    size = rules.agg(F.max(F.size(F.split("host", "[.]"))), F.max(F.length("path"))).first()
    labels, reach = int(size[0] or 1), int(size[1] or 0)
    urls = written(pages.selectExpr(f"`{page_id}` as page_id", f"{host} as host", f"{path} as path")
                   .withColumn("row", F.monotonically_increasing_id()), "urls")
    tails = urls.selectExpr("row", "path", "reverse(split(host, '[.]')) as labels").selectExpr(
        "row", "path", "labels", f"explode(sequence(1, least({labels}, size(labels)))) as tail")
    keyed = tails.selectExpr(
        _key("slice(labels, 1, tail)", f"substring(path, 1, {reach})") + " as key", "1 as kind", "row", "null as stack")
    events = keyed.unionByName(starts.selectExpr("start as key", "0 as kind", "cast(null as long) as row", "stack"))
    swept = written(events.repartitionByRange("key", "kind", "row").withColumn("task", F.spark_partition_id()),
                    "url-events")
    # The last start of every task, handed to the tasks after it.
    ends = (swept.groupBy("task").agg(F.max(F.when(F.col("kind") == 0, F.col("key"))).alias("key"))
            .selectExpr("task", "max(key) over (order by task rows between unbounded preceding and 1 preceding) as start"))
    carried = ends.join(starts, "start").selectExpr(
        "cast('' as string) as key", "0 as kind", "cast(null as long) as row", "stack", "task")
    active = swept.unionByName(carried).selectExpr(
        "row", "key", "last_value(stack) ignore nulls over (partition by task order by key, kind "
                      "rows between unbounded preceding and current row) as stack")
    # Tails of a url compete by length of host + path, then by host.
    best = (active.where("row is not null")
            .selectExpr("row", "get(filter(stack, r -> startswith(key, r.key)), 0) as r").where("r is not null")
            .groupBy("row").agg(F.max(F.expr(
                "struct(length(r.host) + length(r.path) as size, length(r.host) as host_size, r.verdict as verdict, "
                "concat(r.host, r.path) as rule)")).alias("best")))
    return urls.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
