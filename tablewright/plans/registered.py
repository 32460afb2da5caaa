"""Registered queries: one Spark plan per operator of the inventory, each
paired with DuckDB SQL that states the same result.

Dirt (nulls, blanks, NA spellings, zeros) is added by the *same* SQL
expressions in the Spark query (``selectExpr``) and in the oracle text, so
the two sides read identical inputs from the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import NA_TEXT_VALUES, WHITESPACE
from ..operators import aggregate as agg
from ..operators import clean, merge, position, profile
from ..plans.workflows import merge_workflow


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- fixtures --

def dirty_customer_cols(k: str = "c_custkey") -> list[str]:
    """Dirt keyed on the expression ``k`` (a shifted key gives dirt elsewhere)."""
    return [
        "c_custkey", "c_nationkey",
        f"CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 13 = 0 THEN '' "
        f"WHEN {k} % 17 = 0 THEN ' n/a ' WHEN {k} % 19 = 0 THEN 'NULL' "
        f"WHEN {k} % 23 = 0 THEN '0' WHEN {k} % 29 = 0 THEN concat('  ', c_mktsegment) "
        "ELSE c_mktsegment END AS seg",
        f"CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 5 = 0 THEN CAST(0 AS DOUBLE) "
        "ELSE c_acctbal END AS bal",
    ]


DIRTY_CUSTOMER_COLS = dirty_customer_cols()
DIRTY_CUSTOMER_SQL = f"SELECT {', '.join(DIRTY_CUSTOMER_COLS)} FROM customer"
# Two tables of all customers: the right one has its keys doubled (so that half
# of either side has no partner) and its dirt on other rows; both have null keys.
LEFT_COLS = ["CASE WHEN c_custkey % 500 = 0 THEN NULL ELSE c_custkey END AS c_custkey", *DIRTY_CUSTOMER_COLS[1:]]
RIGHT_COLS = ["CASE WHEN c_custkey % 400 = 0 THEN NULL ELSE c_custkey * 2 END AS c_custkey",
              *dirty_customer_cols("(c_custkey + 3)")[1:]]
LEFT_SQL = f"SELECT {', '.join(LEFT_COLS)} FROM customer"
RIGHT_SQL = f"SELECT {', '.join(RIGHT_COLS)} FROM customer"

NULL_ORDERKEY = "CASE WHEN o_orderkey % 5000 = 0 THEN NULL ELSE o_orderkey END"
NULL_LINE_ORDERKEY = "CASE WHEN l_orderkey % 5000 = 0 THEN NULL ELSE l_orderkey END"


def dirty_customer(spark, d):
    return read(spark, d, "customer").selectExpr(*DIRTY_CUSTOMER_COLS)


def left_table(spark, d):
    return read(spark, d, "customer").selectExpr(*LEFT_COLS)


def right_table(spark, d):
    return read(spark, d, "customer").selectExpr(*RIGHT_COLS)


# SQL spellings of the predicates (DuckDB), mirroring tablewright.functions.
WS = WHITESPACE
NA_LIST = ", ".join(f"'{v}'" for v in NA_TEXT_VALUES)


def sql_missing_text(c):
    return f"({c} IS NULL OR trim({c}, '{WS}') = '' OR lower(trim({c}, '{WS}')) IN ({NA_LIST}))"


def sql_missing_num(c):
    return f"({c} IS NULL OR isnan({c}))"


def sql_zero_text(c):
    return f"(CASE WHEN {c} IS NULL THEN NULL ELSE trim({c}, '{WS}') = '0' END)"


def sql_zero_num(c):
    return f"(CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE {c} = 0 END)"


def sql_bad_text(c):
    return f"(coalesce({sql_zero_text(c)}, false) OR {sql_missing_text(c)})"


def sql_bad_num(c):
    return f"(coalesce({sql_zero_num(c)}, false) OR {sql_missing_num(c)})"


def sql_zfill(s, w):
    return (f"(CASE WHEN length({s}) >= {w} THEN {s} "
            f"WHEN regexp_matches({s}, '^[+-]') THEN substr({s}, 1, 1) || lpad(substr({s}, 2), {w - 1}, '0') "
            f"ELSE lpad({s}, {w}, '0') END)")


# ------------------------------------------------------------------ merges --

WORKFLOW_RULES = [("l_quantity", "sum", "total_qty"), ("l_linenumber", "count", "n_lines"),
                  ("l_partkey", "nunique", "n_parts")]


def q_merge_workflow(spark, d):
    orders = read(spark, d, "orders").selectExpr(
        f"{NULL_ORDERKEY} AS o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    lines = read(spark, d, "lineitem").selectExpr(
        f"{NULL_LINE_ORDERKEY} AS l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    merged = merge_workflow(orders, lines, "o_orderkey", "l_orderkey", "left",
                            aggregate_specs=WORKFLOW_RULES, coalesce=True)
    return agg.binary_flag(merged, "total_qty", 50, "big_order")


SQL_MERGE_WORKFLOW = f"""
WITH o AS (SELECT {NULL_ORDERKEY} AS o_orderkey, o_custkey, o_orderstatus, o_totalprice,
                  o_orderdate, o_orderpriority FROM orders),
     l AS (SELECT {NULL_LINE_ORDERKEY} AS l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem),
     a AS (SELECT l_orderkey, coalesce(sum(l_quantity), 0) AS total_qty,
                  count(l_linenumber) AS n_lines, count(DISTINCT l_partkey) AS n_parts
           FROM l GROUP BY l_orderkey)
SELECT coalesce(o.o_orderkey, a.l_orderkey) AS o_orderkey, o.o_custkey, o.o_orderstatus,
       o.o_totalprice, o.o_orderdate, o.o_orderpriority, a.total_qty, a.n_lines, a.n_parts,
       CASE WHEN coalesce(a.total_qty, 0) > 50 THEN 1 ELSE 0 END AS big_order
FROM o LEFT JOIN a ON o.o_orderkey IS NOT DISTINCT FROM a.l_orderkey
"""



QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query (and its DuckDB text, when SQL can state it)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


query("merge_workflow", SQL_MERGE_WORKFLOW)(q_merge_workflow)


def rnd(df: DataFrame, digits: int = 6, cols=None) -> DataFrame:
    """Round double columns for a float-stable comparison (same rounding in SQL)."""
    names = cols or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


# -------------------------------------------------------------- predicates --

@query("missing_flags", f"""
SELECT c_custkey, {sql_missing_text('seg')} AS seg_missing, {sql_missing_num('bal')} AS bal_missing,
       (c_nationkey IS NULL) AS nation_missing
FROM ({DIRTY_CUSTOMER_SQL})""")
def q_missing_flags(spark, d):
    from ..functions import is_missing
    df = dirty_customer(spark, d)
    s = df.schema
    return df.select("c_custkey",
                     is_missing(F.col("seg"), s["seg"].dataType).alias("seg_missing"),
                     is_missing(F.col("bal"), s["bal"].dataType).alias("bal_missing"),
                     is_missing(F.col("c_nationkey"), s["c_nationkey"].dataType).alias("nation_missing"))


@query("zero_flags", f"""
SELECT c_custkey, {sql_zero_text('seg')} AS seg_zero, {sql_zero_num('bal')} AS bal_zero,
       {sql_zero_num('c_nationkey')} AS nation_zero
FROM ({DIRTY_CUSTOMER_SQL})""")
def q_zero_flags(spark, d):
    from ..functions import is_zero
    df = dirty_customer(spark, d)
    s = df.schema
    return df.select("c_custkey",
                     is_zero(F.col("seg"), s["seg"].dataType).alias("seg_zero"),
                     is_zero(F.col("bal"), s["bal"].dataType).alias("bal_zero"),
                     is_zero(F.col("c_nationkey"), s["c_nationkey"].dataType).alias("nation_zero"))


@query("bad_flags", f"""
SELECT c_custkey, {sql_bad_text('seg')} AS seg_bad, {sql_bad_num('bal')} AS bal_bad,
       {sql_bad_num('c_nationkey')} AS nation_bad
FROM ({DIRTY_CUSTOMER_SQL})""")
def q_bad_flags(spark, d):
    from ..functions import is_bad
    df = dirty_customer(spark, d)
    s = df.schema
    return df.select("c_custkey",
                     is_bad(F.col("seg"), s["seg"].dataType).alias("seg_bad"),
                     is_bad(F.col("bal"), s["bal"].dataType).alias("bal_bad"),
                     is_bad(F.col("c_nationkey"), s["c_nationkey"].dataType).alias("nation_bad"))


# --------------------------------------------------------------- profiling --

def _sql_profile_row(col, dtype, zero, empty, na, distinct_expr):
    return (f"SELECT '{col}' AS \"column\", '{dtype}' AS dtype, count(*) AS \"rows\", "
            f"round(coalesce(avg(CAST({zero} AS DOUBLE)), 0.0), 9) AS zero_ratio, "
            f"round(coalesce(avg(CAST({empty} AS DOUBLE)), 0.0), 9) AS empty_ratio, "
            f"round(coalesce(avg(CAST({na} AS DOUBLE)), 0.0), 9) AS na_ratio, "
            f"count(DISTINCT {distinct_expr}) AS unique_count FROM ({DIRTY_CUSTOMER_SQL})")


SQL_COLUMN_PROFILE = " UNION ALL ".join([
    _sql_profile_row("seg", "string", sql_zero_text("seg"), f"(seg IS NULL OR trim(seg, '{WS}') = '')",
                     f"(seg IS NULL OR lower(trim(seg, '{WS}')) IN ({NA_LIST}))", "seg"),
    _sql_profile_row("bal", "double", sql_zero_num("bal"), sql_missing_num("bal"), sql_missing_num("bal"),
                     "CASE WHEN isnan(bal) THEN NULL ELSE bal END"),
    _sql_profile_row("c_nationkey", "int", sql_zero_num("c_nationkey"), "(c_nationkey IS NULL)",
                     "(c_nationkey IS NULL)", "c_nationkey"),
])


@query("column_profile", SQL_COLUMN_PROFILE)
def q_column_profile(spark, d):
    return rnd(profile.column_profile(dirty_customer(spark, d), ["seg", "bal", "c_nationkey"]), 9)


def _sql_top(label_expr, n):
    return (f"SELECT value, count(*) AS count FROM (SELECT {label_expr} AS value FROM ({DIRTY_CUSTOMER_SQL})) "
            f"GROUP BY value ORDER BY count DESC, value ASC LIMIT {n}")


_SEG_LABEL = f"coalesce(nullif(trim(seg, '{WS}'), ''), CASE WHEN seg IS NULL THEN '<NA>' ELSE '<EMPTY>' END)"


@query("top_values", _sql_top(_SEG_LABEL, 20))
def q_top_values(spark, d):
    return profile.top_values(dirty_customer(spark, d), "seg")


@query("top_values_numeric", _sql_top("coalesce(CAST(bal AS VARCHAR), '<NA>')", 20))
def q_top_values_numeric(spark, d):
    return profile.top_values(dirty_customer(spark, d), "bal")


@query("top_categories", _sql_top("coalesce(seg, '<NULL>')", 15))
def q_top_categories(spark, d):
    return profile.top_categories(dirty_customer(spark, d), "seg")


@query("histogram", """
WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
     w AS (SELECT lo, hi, (hi - lo) / 20 AS step FROM s),
     b AS (SELECT least(CAST(floor((l_quantity - lo) / (hi - lo) * 20) AS INTEGER), 19) AS bin
           FROM lineitem, w WHERE l_quantity IS NOT NULL),
     c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(r.i AS INTEGER) AS bin, round(r.i * w.step + w.lo, 9) AS bin_start,
       round(CASE WHEN r.i = 19 THEN w.hi ELSE (r.i + 1) * w.step + w.lo END, 9) AS bin_end,
       coalesce(c.n, 0) AS count
FROM range(20) r(i) CROSS JOIN w LEFT JOIN c ON c.bin = r.i""")
def q_histogram(spark, d):
    return rnd(profile.histogram(read(spark, d, "lineitem"), "l_quantity"), 9)


# ------------------------------------------------------------------ cleaning --

ORDERS_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def q_drop_columns(spark, d):
    return clean.drop_columns(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("head_preview", f"SELECT {ORDERS_COLS} FROM orders ORDER BY o_orderkey LIMIT 10")
def q_head_preview(spark, d):
    return clean.head(read(spark, d, "orders"), "o_orderkey", 10)


@query("tail_preview", f"SELECT * FROM (SELECT {ORDERS_COLS} FROM orders ORDER BY o_orderkey DESC LIMIT 10) ORDER BY o_orderkey")
def q_tail_preview(spark, d):
    return clean.tail(read(spark, d, "orders"), "o_orderkey", 10)


@query("delete_rows", f"""
SELECT {ORDERS_COLS} FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
WHERE NOT (pos IN (0, 3) OR pos BETWEEN 5 AND 8)""")
def q_delete_rows(spark, d):
    return position.delete_rows(read(spark, d, "orders"), "0, 3, 5-8", "o_orderkey")


@query("zero_fill", f"""
SELECT c_custkey, c_nationkey, CASE WHEN {sql_missing_text('seg')} THEN '0' ELSE seg END AS seg,
       CASE WHEN {sql_missing_num('bal')} THEN 0.0 ELSE bal END AS bal
FROM ({DIRTY_CUSTOMER_SQL})""")
def q_zero_fill(spark, d):
    return clean.zero_fill(dirty_customer(spark, d), ["seg", "bal"])


@query("drop_bad_rows", f"""
SELECT * FROM ({DIRTY_CUSTOMER_SQL})
WHERE (CAST({sql_bad_text('seg')} AS INTEGER) + CAST({sql_bad_num('bal')} AS INTEGER)) / 2.0 < 0.5""")
def q_drop_bad_rows(spark, d):
    return clean.drop_bad_rows(dirty_customer(spark, d), ["seg", "bal"], 0.5)


_LK, _LN = "CAST(l_orderkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)"


@query("zero_pad", f"""
SELECT l_orderkey, l_linenumber, {sql_zfill(_LK, 6)} AS order_code, {sql_zfill(_LN, 2)} AS line_code
FROM lineitem""")
def q_zero_pad(spark, d):
    from ..functions import zfill
    df = read(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber",
                     zfill(F.col("l_orderkey").cast("string"), 6).alias("order_code"),
                     zfill(F.col("l_linenumber").cast("string"), 2).alias("line_code"))


@query("combine_columns", f"""
SELECT l_orderkey, l_linenumber, l_quantity,
       {sql_zfill(_LK, 6)} || '-' || {sql_zfill(_LN, 2)} AS line_id FROM lineitem""")
def q_combine_columns(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return clean.combine_columns(df, "line_id", "l_orderkey", "l_linenumber", "-", 6, 2)


@query("split_column", """
SELECT o_orderkey, o_orderpriority,
       CASE WHEN strpos(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, 1, strpos(o_orderpriority, '-') - 1)
            ELSE coalesce(o_orderpriority, '') END AS prio_rank,
       CASE WHEN strpos(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, strpos(o_orderpriority, '-') + 1)
            ELSE '' END AS prio_name
FROM orders""")
def q_split_column(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return clean.split_column(df, "o_orderpriority", "prio_rank", "prio_name", "-", 1)


@query("split_column_name", """
SELECT p_partkey, p_name,
       CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, 1, strpos(p_name, ' ') - 1)
            ELSE coalesce(p_name, '') END AS name_first,
       CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS name_rest
FROM part""")
def q_split_column_name(spark, d):
    df = read(spark, d, "part").select("p_partkey", "p_name")
    return clean.split_column(df, "p_name", "name_first", "name_rest", " ", 1)


@query("time_range", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00'""")
def q_time_range(spark, d):
    return clean.time_range(read(spark, d, "events"), "ts", "2024-01-05", "2024-01-10")


ORDER_TEXT_DATE = "CASE WHEN o_orderkey % 37 = 0 THEN 'not a date' ELSE CAST(o_orderdate AS STRING) END AS order_day"


@query("time_range_text", f"""
SELECT * FROM (SELECT o_orderkey, o_totalprice, {ORDER_TEXT_DATE.replace('STRING', 'VARCHAR')} FROM orders)
WHERE TRY_CAST(order_day AS TIMESTAMP) >= TIMESTAMP '1996-01-01 00:00:00'
  AND TRY_CAST(order_day AS TIMESTAMP) <= TIMESTAMP '1997-12-31 00:00:00'""")
def q_time_range_text(spark, d):
    df = read(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", ORDER_TEXT_DATE)
    return clean.time_range(df, "order_day", "1996-01-01", "1997-12-31")


# --------------------------------------------------------------- aggregation --

def _sql_group(key, body):
    return f"SELECT {key}, {body} FROM ({DIRTY_CUSTOMER_SQL}) GROUP BY {key}"


@query("group_nulls", _sql_group("seg", "count(c_custkey) AS n_customers"))
def q_group_nulls(spark, d):
    return agg.aggregate(dirty_customer(spark, d), "seg", [("c_custkey", "count", "n_customers")])


@query("agg_sum", _sql_group("seg", "round(coalesce(sum(CASE WHEN isnan(bal) THEN NULL ELSE bal END), 0), 4) AS total_bal"))
def q_agg_sum(spark, d):
    return rnd(agg.aggregate(dirty_customer(spark, d), "seg", [("bal", "sum", "total_bal")]), 4)


@query("agg_count", _sql_group("c_nationkey", "count(seg) AS n_seg"))
def q_agg_count(spark, d):
    return agg.aggregate(dirty_customer(spark, d), "c_nationkey", [("seg", "count", "n_seg")])


@query("agg_mean", _sql_group("seg", "round(avg(CASE WHEN isnan(bal) THEN NULL ELSE bal END), 4) AS mean_bal"))
def q_agg_mean(spark, d):
    return rnd(agg.aggregate(dirty_customer(spark, d), "seg", [("bal", "mean", "mean_bal")]), 4)


@query("agg_max", _sql_group("c_nationkey", "max(bal) AS max_bal, max(seg) AS max_seg"))
def q_agg_max(spark, d):
    return agg.aggregate(dirty_customer(spark, d), "c_nationkey",
                         [("bal", "max", "max_bal"), ("seg", "max", "max_seg")])


@query("agg_min", _sql_group("c_nationkey", "min(bal) AS min_bal, min(seg) AS min_seg"))
def q_agg_min(spark, d):
    return agg.aggregate(dirty_customer(spark, d), "c_nationkey",
                         [("bal", "min", "min_bal"), ("seg", "min", "min_seg")])


@query("agg_nunique", _sql_group("c_nationkey", "count(DISTINCT seg) AS n_segments"))
def q_agg_nunique(spark, d):
    return agg.aggregate(dirty_customer(spark, d), "c_nationkey", [("seg", "nunique", "n_segments")])


@query("multi_rule_aggregate", _sql_group(
    "seg", "count(c_custkey) AS x, round(avg(bal), 4) AS avg_bal, count(DISTINCT c_nationkey) AS n_nations"))
def q_multi_rule_aggregate(spark, d):
    rules = [("bal", "sum", "x"), ("bal", "mean", "avg_bal"), ("c_custkey", "count", "x"),
             ("c_nationkey", "nunique", "n_nations")]
    return rnd(agg.aggregate(dirty_customer(spark, d), "seg", rules), 4)


@query("binary_flag", """
SELECT l_orderkey, CASE WHEN coalesce(sum(l_quantity), 0) > 50 THEN 1 ELSE 0 END AS qty
FROM lineitem GROUP BY l_orderkey""")
def q_binary_flag(spark, d):
    out = agg.aggregate(read(spark, d, "lineitem"), "l_orderkey", [("l_quantity", "sum", "qty")])
    return agg.binary_flag(out, "qty", 50)


_AMOUNT_TEXT = ("CASE l_orderkey % 13 WHEN 0 THEN '5d' WHEN 1 THEN ' 8 ' WHEN 2 THEN '1e3' WHEN 3 THEN 'inf' "
                "WHEN 4 THEN '-3.5' WHEN 5 THEN 'abc' WHEN 6 THEN NULL WHEN 7 THEN '7f' WHEN 8 THEN '.5' "
                "WHEN 9 THEN '1,000' WHEN 10 THEN '-Infinity' WHEN 11 THEN '9.' ELSE CAST(l_quantity AS {}) END")


@query("binary_flag_text", f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN regexp_full_match(t, '\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*')
              THEN CASE WHEN CAST(trim(t) AS DOUBLE) > 4 THEN 1 ELSE 0 END
            WHEN lower(trim(t)) IN ('inf', '+inf', 'infinity', '+infinity') THEN 1 ELSE 0 END AS big
FROM (SELECT l_orderkey, l_linenumber, {_AMOUNT_TEXT.format("VARCHAR")} AS t FROM lineitem)""")
def q_binary_flag_text(spark, d):
    """The flag of a text column: words, suffixed digits and blanks are no numbers."""
    lines = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_AMOUNT_TEXT.format('STRING')} AS t")
    return agg.binary_flag(lines, "t", 4, "big").drop("t")


@query("aggregate_to_binary", """
SELECT l_orderkey, coalesce(sum(l_quantity), 0) AS qty, count(l_linenumber) AS n_lines,
       CASE WHEN coalesce(sum(l_quantity), 0) > 50 THEN 1 ELSE 0 END AS is_big
FROM lineitem GROUP BY l_orderkey""")
def q_aggregate_to_binary(spark, d):
    from ..plans.workflows import aggregate_workflow
    return aggregate_workflow(read(spark, d, "lineitem"), "l_orderkey",
                              [("l_quantity", "sum", "qty"), ("l_linenumber", "count", "n_lines")],
                              {"source_column": "qty", "threshold": 50, "output_column": "is_big"})


# -------------------------------------------------------------------- merges --

# Orders and lines with null keys on both sides, and keys without a partner.
ORDER_COLS = [f"{NULL_ORDERKEY} AS k", "o_custkey", "o_totalprice AS amount"]
LINE_COLS = ["CASE WHEN l_orderkey % 5000 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN -l_orderkey ELSE l_orderkey END AS k",
             "l_linenumber", "l_extendedprice AS amount"]


def _sql_merge(join, key_expr):
    return f"""
SELECT {key_expr} AS k, l.o_custkey, l.amount AS amount_x, r.l_linenumber, r.amount AS amount_y
FROM (SELECT {', '.join(ORDER_COLS)} FROM orders) l {join} (SELECT {', '.join(LINE_COLS)} FROM lineitem) r
  ON l.k IS NOT DISTINCT FROM r.k"""


def _merge_query(how):
    def fn(spark, d):
        return merge.merge(read(spark, d, "orders").selectExpr(*ORDER_COLS),
                           read(spark, d, "lineitem").selectExpr(*LINE_COLS), "k", "k", how)
    return fn


for _how, _join, _key in (("inner", "JOIN", "l.k"), ("left", "LEFT JOIN", "l.k"), ("right", "RIGHT JOIN", "r.k"),
                          ("outer", "FULL OUTER JOIN", "coalesce(l.k, r.k)")):
    query(f"merge_{_how}", _sql_merge(_join, _key))(_merge_query(_how))


def _renamed_right(spark, d):
    return right_table(spark, d).withColumnRenamed("c_custkey", "cust_id")


@query("merge_suffixes", f"""
SELECT l.c_custkey, l.c_nationkey AS c_nationkey_x, l.seg AS seg_x, l.bal AS bal_x, r.c_custkey AS cust_id,
       r.c_nationkey AS c_nationkey_y, r.seg AS seg_y, r.bal AS bal_y
FROM ({LEFT_SQL}) l JOIN ({RIGHT_SQL}) r ON l.c_custkey IS NOT DISTINCT FROM r.c_custkey""")
def q_merge_suffixes(spark, d):
    return merge.merge(left_table(spark, d), _renamed_right(spark, d), "c_custkey", "cust_id", "inner")


def _sql_pick(strategy, lx, ly, lmiss, rmiss):
    if strategy == "prefer_right":
        return f"CASE WHEN NOT {rmiss} THEN {ly} ELSE {lx} END"
    if strategy == "prefer_left":
        return f"CASE WHEN NOT {lmiss} THEN {lx} ELSE {ly} END"
    return f"CASE WHEN NOT {lmiss} THEN {lx} WHEN NOT {rmiss} THEN {ly} ELSE {lx} END"


def _sql_coalesce(strategy, key_cols, on):
    pick = lambda a, b, kind: _sql_pick(
        strategy, a, b,
        sql_missing_text(a) if kind == "text" else sql_missing_num(a),
        sql_missing_text(b) if kind == "text" else sql_missing_num(b))
    return f"""
SELECT {key_cols},
       {pick('l.c_nationkey', 'r.c_nationkey', 'num')} AS c_nationkey,
       {pick('l.seg', 'r.seg', 'text')} AS seg,
       {pick('l.bal', 'r.bal', 'num')} AS bal
FROM ({LEFT_SQL}) l FULL OUTER JOIN ({RIGHT_SQL}) r ON {on}"""


def _coalesce_query(strategy):
    def fn(spark, d):
        merged = merge.merge(left_table(spark, d), right_table(spark, d), "c_custkey", "c_custkey", "outer")
        return merge.coalesce_merged(merged, strategy, "c_custkey", "c_custkey")
    return fn


for _strategy in ("first_non_empty", "prefer_left", "prefer_right"):
    query(f"coalesce_{_strategy}", _sql_coalesce(
        _strategy, "coalesce(l.c_custkey, r.c_custkey) AS c_custkey",
        "l.c_custkey IS NOT DISTINCT FROM r.c_custkey"))(_coalesce_query(_strategy))


@query("coalesce_keys", _sql_coalesce(
    "first_non_empty", "coalesce(l.c_custkey, r.c_custkey) AS c_custkey",
    "l.c_custkey IS NOT DISTINCT FROM r.c_custkey"))
def q_coalesce_keys(spark, d):
    merged = merge.merge(left_table(spark, d), _renamed_right(spark, d), "c_custkey", "cust_id", "outer")
    return merge.coalesce_merged(merged, "first_non_empty", "c_custkey", "cust_id")


@query("append", f"{LEFT_SQL} UNION ALL {RIGHT_SQL}")
def q_append(spark, d):
    return merge.merge(left_table(spark, d), right_table(spark, d), "", "", "append")


@query("merge_preaggregated", f"""
WITH o AS (SELECT {NULL_ORDERKEY} AS o_orderkey, o_custkey, o_totalprice FROM orders),
     a AS (SELECT {NULL_LINE_ORDERKEY} AS l_orderkey, coalesce(sum(l_extendedprice), 0) AS revenue,
                  max(l_shipdate) AS last_ship
           FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, a.l_orderkey, round(a.revenue, 4) AS revenue, a.last_ship
FROM o JOIN a ON o.o_orderkey IS NOT DISTINCT FROM a.l_orderkey""")
def q_merge_preaggregated(spark, d):
    orders = read(spark, d, "orders").selectExpr(f"{NULL_ORDERKEY} AS o_orderkey", "o_custkey", "o_totalprice")
    lines = read(spark, d, "lineitem").selectExpr(
        f"{NULL_LINE_ORDERKEY} AS l_orderkey", "l_extendedprice", "l_shipdate")
    out = merge_workflow(orders, lines, "o_orderkey", "l_orderkey", "inner",
                         aggregate_specs=[("l_extendedprice", "sum", "revenue"), ("l_shipdate", "max", "last_ship")])
    return rnd(out, 4)


def _sql_risk(left_sql, lk, right_sql, rk):
    return f"""
WITH l AS (SELECT count(*) AS n, count(DISTINCT {lk}) + max(CASE WHEN {lk} IS NULL THEN 1 ELSE 0 END) AS u FROM ({left_sql})),
     r AS (SELECT count(*) AS n, count(DISTINCT {rk}) + max(CASE WHEN {rk} IS NULL THEN 1 ELSE 0 END) AS u FROM ({right_sql}))
SELECT l.n AS left_rows, r.n AS right_rows, CAST(l.u AS BIGINT) AS left_unique, CAST(r.u AS BIGINT) AS right_unique,
       greatest(l.n - l.u, 0) AS left_duplicates, greatest(r.n - r.u, 0) AS right_duplicates,
       (l.n - l.u) <= 0 AS left_is_unique, (r.n - r.u) <= 0 AS right_is_unique,
       CASE WHEN (l.n - l.u) <= 0 AND (r.n - r.u) <= 0 THEN 'Low'
            WHEN (l.n - l.u) <= 0 OR (r.n - r.u) <= 0 THEN 'Medium' ELSE 'High' END AS risk_level
FROM l, r"""


@query("merge_risk", _sql_risk("SELECT o_custkey FROM orders", "o_custkey", "SELECT c_custkey FROM customer", "c_custkey"))
def q_merge_risk(spark, d):
    return merge.merge_risk(read(spark, d, "orders"), read(spark, d, "customer"), "o_custkey", "c_custkey")


@query("merge_risk_lines", _sql_risk(
    f"SELECT {NULL_LINE_ORDERKEY} AS k FROM lineitem", "k", f"SELECT {NULL_ORDERKEY} AS k FROM orders", "k"))
def q_merge_risk_lines(spark, d):
    lines = read(spark, d, "lineitem").selectExpr(f"{NULL_LINE_ORDERKEY} AS l_orderkey")
    orders = read(spark, d, "orders").selectExpr(f"{NULL_ORDERKEY} AS o_orderkey")
    return merge.merge_risk(lines, orders, "l_orderkey", "o_orderkey")


# ------------------------------------------------------- model preparation --

from ..operators import evaluate, prepare  # noqa: E402

_SEG_NORM = f"CASE WHEN {sql_missing_text('seg')} THEN NULL ELSE seg END"
_DC = f"({DIRTY_CUSTOMER_SQL})"
_MEDIAN_BAL = f"(SELECT median(CASE WHEN isnan(bal) THEN NULL ELSE bal END) FROM {_DC})"
_MODE_SEG = (f"(SELECT s FROM (SELECT {_SEG_NORM} AS s FROM {_DC}) WHERE s IS NOT NULL "
             "GROUP BY s ORDER BY count(*) DESC, s ASC LIMIT 1)")


@query("task_type", f"""
SELECT 'c_nationkey' AS "column", count(DISTINCT c_nationkey) AS n_distinct,
       CASE WHEN count(DISTINCT c_nationkey) <= 20 THEN 'classification' ELSE 'regression' END AS task_type
FROM {_DC}
UNION ALL SELECT 'seg', CAST(NULL AS BIGINT), 'classification'
UNION ALL
SELECT 'bal', count(DISTINCT bal),
       CASE WHEN count(DISTINCT bal) <= 20 THEN 'classification' ELSE 'regression' END FROM {_DC}
UNION ALL
SELECT 'quality', (SELECT count(DISTINCT quality) FROM labels), 'classification'""")
def q_task_type(spark, d):
    dc = prepare.task_types(dirty_customer(spark, d), ["c_nationkey", "seg", "bal"])
    lab = prepare.task_types(read(spark, d, "labels"), ["quality"])
    return dc.unionByName(lab)


@query("normalize_features", f"SELECT c_custkey, c_nationkey, {_SEG_NORM} AS seg, bal FROM {_DC}")
def q_normalize_features(spark, d):
    return prepare.normalize_features(dirty_customer(spark, d), ["c_nationkey", "seg", "bal"])


@query("training_frame", f"""
SELECT c_nationkey, {_SEG_NORM} AS seg, CASE WHEN {sql_missing_num('bal')} THEN 0.0 ELSE bal END AS bal
FROM {_DC}""")
def q_training_frame(spark, d):
    return prepare.training_frame(dirty_customer(spark, d), ["c_nationkey", "seg"], "bal")


@query("training_frame_text", f"""
SELECT c_nationkey, bal, CASE WHEN {sql_missing_text('seg')} THEN '0' ELSE seg END AS seg FROM {_DC}""")
def q_training_frame_text(spark, d):
    return prepare.training_frame(dirty_customer(spark, d), ["c_nationkey", "bal"], "seg")


@query("impute_median", f"SELECT c_custkey, coalesce(bal, {_MEDIAN_BAL}) AS bal_filled FROM {_DC}")
def q_impute_median(spark, d):
    from ..operators.select import exact_median
    df = dirty_customer(spark, d)
    med = exact_median(df, "bal")
    return df.select("c_custkey", F.coalesce(F.col("bal"), F.lit(med)).alias("bal_filled"))


@query("impute_mode", f"SELECT c_custkey, coalesce({_SEG_NORM}, {_MODE_SEG}) AS seg_filled FROM {_DC}")
def q_impute_mode(spark, d):
    df = prepare.normalize_features(dirty_customer(spark, d), ["seg"])
    mode = prepare.most_frequent(df, "seg")
    return df.select("c_custkey", F.coalesce(F.col("seg"), F.lit(mode)).alias("seg_filled"))


@query("standard_scale", f"""
WITH f AS (SELECT c_custkey, coalesce(bal, {_MEDIAN_BAL}) AS x FROM {_DC}),
     s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM f)
SELECT c_custkey, round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS bal_scaled FROM f, s""")
def q_standard_scale(spark, d):
    df = dirty_customer(spark, d)
    prep = prepare.fit_preprocessor(df, ["bal"])
    return prep.transform(df).select("c_custkey", F.round("__num_bal", 6).alias("bal_scaled"))


@query("one_hot", f"""
WITH f AS (SELECT c_custkey, coalesce({_SEG_NORM}, {_MODE_SEG}) AS seg_category FROM {_DC})
SELECT c_custkey, seg_category, CAST(dense_rank() OVER (ORDER BY seg_category) - 1 AS INTEGER) AS seg_index,
       CAST(dense_rank() OVER (ORDER BY seg_category) - 1 AS INTEGER) AS hot_slot,
       CAST((SELECT count(DISTINCT seg_category) FROM f) AS INTEGER) AS width
FROM f""")
def q_one_hot(spark, d):
    from pyspark.ml.functions import vector_to_array
    df = dirty_customer(spark, d)
    prep = prepare.fit_preprocessor(df, ["seg"])
    out = prep.transform(df)
    arr = vector_to_array("__vec_seg")
    return out.select("c_custkey", F.col("__cat_seg").alias("seg_category"),
                      F.col("__idx_seg").cast("int").alias("seg_index"),
                      (F.array_position(arr, 1.0) - 1).cast("int").alias("hot_slot"),
                      F.size(arr).alias("width"))


_LABEL_HASH = "md5(CAST(doc_id AS VARCHAR) || '|42')"


@query("holdout_split", f"""
SELECT doc_id, quality, toxic, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {_LABEL_HASH}) AS rn,
             CAST(ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS BIGINT) AS k FROM labels)""")
def q_holdout_split(spark, d):
    return prepare.holdout_split(read(spark, d, "labels"), "doc_id")


@query("stratified_split", f"""
SELECT doc_id, quality, toxic, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_LABEL_HASH}) AS rn,
             round(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY quality)) AS k FROM labels)""")
def q_stratified_split(spark, d):
    return prepare.stratified_split(read(spark, d, "labels"), "doc_id", "quality")


@query("classification_metrics", """
WITH conf AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p, count(*) AS n
              FROM labels GROUP BY 1, 2),
     cls AS (SELECT y AS c FROM conf UNION SELECT p FROM conf),
     per AS (SELECT c,
                    CAST(coalesce((SELECT sum(n) FROM conf WHERE y = c), 0) AS DOUBLE) AS support,
                    CAST(coalesce((SELECT sum(n) FROM conf WHERE p = c), 0) AS DOUBLE) AS predicted,
                    CAST(coalesce((SELECT sum(n) FROM conf WHERE y = c AND p = c), 0) AS DOUBLE) AS tp
             FROM cls),
     m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
                     CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM per)
SELECT round(sum(tp) / sum(support), 9) AS accuracy,
       round(sum(prec * support) / sum(support), 9) AS precision,
       round(sum(rec * support) / sum(support), 9) AS recall,
       round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * support)
             / sum(support), 9) AS f1
FROM m""")
def q_classification_metrics(spark, d):
    return rnd(evaluate.classification_metrics(read(spark, d, "labels"), "quality", "toxic"), 9)


@query("regression_metrics", """
SELECT round(avg(abs(l_extendedprice - l_quantity * 1500)), 6) AS mae,
       round(sqrt(avg(power(l_extendedprice - l_quantity * 1500, 2))), 6) AS rmse,
       round(1 - sum(power(l_extendedprice - l_quantity * 1500, 2))
                 / (var_pop(l_extendedprice) * count(l_extendedprice)), 6) AS r2
FROM lineitem""")
def q_regression_metrics(spark, d):
    df = read(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 1500)
    return rnd(evaluate.regression_metrics(df, "l_extendedprice", "pred"), 6)


# ------------------------------------------------------------------ training --
# A model's numbers are its own, so these queries fit it and return facts that
# SQL can state: rows scored and seen, labels outside the domain, rows that differ.

from ..operators import models as model_registry  # noqa: E402
from ..operators import train as trainer  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources.registry import Registry  # noqa: E402

LINE_KEYS = ["l_orderkey", "l_linenumber"]
CLS_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]
REG_FEATURES = ["l_quantity", "l_discount", "l_tax"]
FOREST = {"n_estimators": 20, "max_depth": 8}

# Targets that follow from the features, so that a model that has learned
# nothing fails: a class and a number.
BAND = "CASE WHEN l_linestatus = 'F' THEN 'A' WHEN l_quantity > 25 THEN 'N' ELSE 'R' END"
CHARGE = "5 + l_quantity / 10 - 20 * l_discount + 10 * l_tax"
LINES = f"(SELECT *, {BAND} AS l_band, {CHARGE} AS l_charge FROM lineitem)"


def with_targets(lines: DataFrame) -> DataFrame:
    return lines.selectExpr("*", f"{BAND} AS l_band", f"{CHARGE} AS l_charge")


def signal_lines(spark, d):
    return with_targets(read(spark, d, "lineitem"))


def _classifier(spark, d):
    return trainer.train_model(signal_lines(spark, d), CLS_FEATURES, "l_band",
                               "RandomForestClassifier", "classification", FOREST, key_cols=LINE_KEYS)


def _label_facts(scored: DataFrame, domain: DataFrame) -> DataFrame:
    """Per true label: rows, rows without a prediction, rows predicted outside the
    domain, and whether more than nine of ten rows are right."""
    known = F.broadcast(domain.select(F.col("l_band").alias("known")).distinct())  # a row per class
    p = F.col("l_band Prediction")
    return (scored.join(known, p == F.col("known"), "left").groupBy("l_band")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(p.isNull()).alias("n_null"),
                 F.count_if(p.isNotNull() & F.col("known").isNull()).alias("n_outside"),
                 (F.avg((p == F.col("l_band")).cast("double")) > 0.9).alias("learned"))
            .select("l_band", "n_rows", "n_null", "n_outside", "learned"))


def _r2(target: str):
    """R squared of the target's predictions, as an aggregate."""
    y, p = F.col(target).cast("double"), F.col(f"{target} Prediction")
    return 1 - F.avg((y - p) * (y - p)) / F.var_pop(y)


@query("train_classifier", f"""
SELECT l_band, CAST(round(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_rows, 0 AS n_null, 0 AS n_outside,
       true AS learned
FROM {LINES} GROUP BY l_band""")
def q_train_classifier(spark, d):
    """Hold-out rows scored by a forest trained on the other 80%, by true label."""
    model = _classifier(spark, d)
    return _label_facts(trainer.predict(model, model.eval_rows), signal_lines(spark, d))


@query("predict", f"""
SELECT l_band, count(*) AS n_rows, 0 AS n_null, 0 AS n_outside, true AS learned FROM {LINES} GROUP BY l_band""")
def q_predict(spark, d):
    """Every lineitem row plus ``l_band Prediction``, by true label."""
    lines = signal_lines(spark, d)
    return _label_facts(trainer.predict(_classifier(spark, d), lines), lines)


_N_CLS_FEATURES = "3 + (SELECT count(DISTINCT l_linestatus) FROM lineitem)"


@query("feature_importance", f"""
SELECT {_N_CLS_FEATURES} AS n_features, 1.0::DOUBLE AS total, 0 AS n_negative, true AS falling""")
def q_feature_importance(spark, d):
    """A forest's importances: one per feature and category, shares of 1, in falling order."""
    return _importance_facts(spark, _classifier(spark, d).importance_frame(spark))


def _importance_facts(spark, frame):
    values = [r["importance"] for r in frame.collect()]
    return spark.range(1).select(F.lit(len(values)).cast("long").alias("n_features"),
                                 F.lit(round(sum(values), 6)).alias("total"),
                                 F.lit(sum(v < 0 for v in values)).cast("long").alias("n_negative"),
                                 F.lit(values == sorted(values, reverse=True)).alias("falling"))


@query("feature_importance_top", """
SELECT least(15, 2 + (SELECT count(DISTINCT l_quantity) FROM lineitem)) AS n_features, 0 AS n_negative, true AS falling""")
def q_feature_importance_top(spark, d):
    """The 15 most important of a model's features, quantities as categories."""
    lines = signal_lines(spark, d).withColumn("qty", F.col("l_quantity").cast("int").cast("string"))
    model = trainer.train_model(lines, ["qty", "l_extendedprice", "l_discount"], "l_band",
                                "RandomForestClassifier", "classification", {"n_estimators": 5, "max_depth": 4},
                                key_cols=LINE_KEYS)
    return _importance_facts(spark, model.top_importances(spark)).drop("total")


@query("model_round_trip", "SELECT count(*) AS n_rows, 0 AS n_differ FROM lineitem")
def q_model_round_trip(spark, d):
    """Rows that a saved and loaded model predicts differently: none."""
    path, lines, model = scratch_path(spark, "model"), read(spark, d, "lineitem"), _classifier(spark, d)
    trainer.save_model(model, path)
    name = "l_band Prediction"
    both = trainer.predict(trainer.load_model(spark, path),
                           trainer.predict(model, lines).withColumnRenamed(name, "before"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(~F.col("before").eqNullSafe(F.col(name))).alias("n_differ"))


@query("train_regressor", """
SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_rows, 0 AS n_null, true AS learned FROM lineitem""")
def q_train_regressor(spark, d):
    """Boosted trees: hold-out rows, those without a prediction, and whether R
    squared on them is above 0.9."""
    model = trainer.train_model(signal_lines(spark, d), REG_FEATURES, "l_charge", "GradientBoostingRegressor",
                                "regression", {"n_estimators": 20, "learning_rate": 0.1}, key_cols=LINE_KEYS)
    return trainer.predict(model, model.eval_rows).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_charge Prediction").isNull()).alias("n_null"),
        (_r2("l_charge") > 0.9).alias("learned"))


# Rings and waves over orders: price and day, scaled to about -1 .. 1.
_U, _V = "(o_totalprice / 250000 - 1)", "(date_diff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) / 1300.0 - 1)"
_SPARK_V = "(timestampdiff(DAY, TIMESTAMP_NTZ '1992-01-01 00:00:00', o_orderdate) / 1300.0 - 1)"


def _curved_orders(spark, d):
    return read(spark, d, "orders").selectExpr(
        "o_orderkey", f"cast({_U} as double) as u", f"cast({_SPARK_V} as double) as v").selectExpr(
        "*", "case when u * u + v * v < 0.5 then 'core' else 'rim' end as ring", "sin(4 * u) + v * v as wave",
        "case when sin(4 * u) + v > 0.6 then 'high' when sin(4 * u) + v > -0.4 then 'mid' else 'low' end as tier")


_RING = f"CASE WHEN {_U} * {_U} + {_V} * {_V} < 0.5 THEN 'core' ELSE 'rim' END"
_TIER = f"CASE WHEN sin(4 * {_U}) + {_V} > 0.6 THEN 'high' WHEN sin(4 * {_U}) + {_V} > -0.4 THEN 'mid' ELSE 'low' END"


def _held_out_of(label: str) -> str:
    return f"(SELECT sum(CAST(round(CAST(0.2 AS DOUBLE) * n) AS BIGINT)) FROM (SELECT count(*) AS n FROM orders GROUP BY {label}))"


def _right(model, target: str) -> DataFrame:
    hit = F.col(f"{target} Prediction") == F.col(target)
    return (trainer.predict(model, model.eval_rows)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(hit.cast("double")).alias("share")))


@query("kernel_classifier", f"""
SELECT CAST({_held_out_of(_RING)} AS BIGINT) AS n_rows, true AS learned, true AS beats_linear""")
def q_kernel_classifier(spark, d):
    """A disc in a plane, which no line separates: hold-out rows, whether the
    kernel machine has 95 of 100 right, and a logistic model at least 10 fewer."""
    from concurrent.futures import ThreadPoolExecutor
    orders = _curved_orders(spark, d)
    prepared = trainer.prepare_training(orders, ["u", "v"], "ring", "classification", ["o_orderkey"])

    def fit(name):
        model = trainer.train_model(orders, ["u", "v"], "ring", name, "classification", key_cols=["o_orderkey"],
                                    prepared=prepared)
        return _right(model, "ring")

    try:
        with ThreadPoolExecutor(max_workers=2) as pool:
            kernel, line = pool.map(fit, ["SVC", "LogisticRegression"])
    finally:
        prepared.release()
    return kernel.join(line.withColumnsRenamed({"n_rows": "n_line", "share": "share_line"})).select(
        "n_rows", (F.col("share") >= 0.95).alias("learned"),
        (F.col("share_line") <= F.col("share") - 0.1).alias("beats_linear"))


@query("kernel_regressor", """
SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_rows, 0 AS n_null, true AS learned FROM orders""")
def q_kernel_regressor(spark, d):
    """A curve fitted with the epsilon-insensitive loss: hold-out rows, those
    without a prediction, and whether R squared on them is above 0.95."""
    model = trainer.train_model(_curved_orders(spark, d), ["u", "v"], "wave", "SVR", "regression",
                                key_cols=["o_orderkey"])
    return trainer.predict(model, model.eval_rows).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("wave Prediction").isNull()).alias("n_null"),
        (_r2("wave") > 0.95).alias("learned"))


@query("boosted_classes", f"""
SELECT CAST({_held_out_of(_TIER)} AS BIGINT) AS n_rows, true AS learned, true AS falls""")
def q_boosted_classes(spark, d):
    """Three classes boosted together: hold-out rows, whether nine of ten are
    right, and whether the log-loss fell in every round."""
    model = trainer.train_model(_curved_orders(spark, d), ["u", "v"], "tier", "GradientBoostingClassifier",
                                "classification", {"n_estimators": 15, "learning_rate": 0.3}, key_cols=["o_orderkey"])
    boosted = model.pipeline.stages[-2]
    losses = boosted.getOrDefault("losses")
    return _right(model, "tier").select("n_rows", (F.col("share") > 0.9).alias("learned"),
                                        F.lit(all(b < a for a, b in zip(losses, losses[1:]))).alias("falls"))


_FIRST = "l_shipdate < TIMESTAMP '1998-06-01 00:00:00'"
_N_TRAIN = f"(SELECT count(*) - CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) FROM lineitem WHERE {_FIRST})"
_N_TRAIN_BY_CLASS = (f"(SELECT CAST(sum(n - round(CAST(0.2 AS DOUBLE) * n)) AS BIGINT) FROM "
                     f"(SELECT count(*) AS n FROM {LINES} WHERE {_FIRST} GROUP BY l_band))")
_N_SECOND = f"(SELECT count(*) FROM lineitem WHERE NOT ({_FIRST}))"


def _incremental_slices(spark, d):
    lines = signal_lines(spark, d)
    cut = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    return lines.where(cut), lines.where(~cut)


def _first_pass(spark, d):
    first, second = _incremental_slices(spark, d)
    return trainer.train_model(first, REG_FEATURES, "l_charge", "SGDRegressor", "regression",
                               key_cols=LINE_KEYS), second


def _pass_facts(spark, d, model):
    scored = trainer.predict(model, signal_lines(spark, d))
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_charge Prediction").isNull()).alias("n_null"),
                      (_r2("l_charge") > 0.9).alias("learned")).select(
        "*", F.lit(model.sgd.n_seen).cast("long").alias("rows_seen"), F.lit(model.sgd.passes).alias("passes"))


@query("incremental_fit", f"""
SELECT count(*) AS n_rows, 0 AS n_null, true AS learned, {_N_TRAIN} AS rows_seen, 1 AS passes FROM lineitem""")
def q_incremental_fit(spark, d):
    """One pass of a linear model: rows scored and rows the model has seen."""
    return _pass_facts(spark, d, _first_pass(spark, d)[0])


@query("incremental_continue", f"""
SELECT count(*) AS n_rows, 0 AS n_null, true AS learned, {_N_TRAIN} + {_N_SECOND} AS rows_seen, 2 AS passes FROM lineitem""")
def q_incremental_continue(spark, d):
    """A second pass over other rows."""
    model, second = _first_pass(spark, d)
    model = trainer.continue_training(model, second, REG_FEATURES, "l_charge")
    return _pass_facts(spark, d, model)


@query("incremental_classifier", f"""
SELECT l_band, count(*) AS n_rows, 0 AS n_null, 0 AS n_outside, true AS learned,
       {_N_TRAIN_BY_CLASS} + {_N_SECOND} AS rows_seen FROM {LINES} GROUP BY l_band""")
def q_incremental_classifier(spark, d):
    """Two passes of a linear classifier."""
    first, second = _incremental_slices(spark, d)
    model = trainer.train_model(first, CLS_FEATURES, "l_band", "SGDClassifier", "classification",
                                key_cols=LINE_KEYS)
    model = trainer.continue_training(model, second, CLS_FEATURES, "l_band")
    lines = signal_lines(spark, d)
    return _label_facts(trainer.predict(model, lines), lines).withColumn(
        "rows_seen", F.lit(model.sgd.n_seen).cast("long"))


@query("model_store", """
SELECT count(*) AS n_rows, 0 AS n_differ, 'price band,price band_2' AS names, 'price band' AS active,
       'price band_2' AS left_over FROM lineitem""")
def q_model_store(spark, d):
    """Two models kept under one name in a durable registry, listed, selected,
    loaded and one deleted by another session; rows that the loaded model
    predicts differently: none."""
    lines = signal_lines(spark, d)
    model = trainer.train_model(lines, ["l_quantity", "l_linestatus"], "l_band", "LogisticRegression",
                                "classification", key_cols=LINE_KEYS)
    folder = scratch_path(spark, "registry")
    for _ in range(2):
        Registry(spark, folder).add_model(model, "price band")
    later = Registry(spark.newSession(), folder)
    names = ",".join(later.names())
    later.select("model", "price band")
    active, loaded = later.active().name, later.load_model()
    later.delete("model", "price band")
    both = trainer.predict(loaded, trainer.predict(model, lines).withColumnRenamed("l_band Prediction", "before"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(~F.col("before").eqNullSafe(F.col("l_band Prediction"))).alias("n_differ")).select(
        "*", F.lit(names).alias("names"), F.lit(active).alias("active"), F.lit(",".join(later.names())).alias("left_over"))


@query("dataset_store", """
SELECT o_orderpriority, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total, 'Orders_2' AS name
FROM orders GROUP BY o_orderpriority""")
def q_dataset_store(spark, d):
    """A result kept as a table of a durable registry, under a taken name, and
    read by another session after the first of that name was deleted."""
    orders = read(spark, d, "orders")
    folder = scratch_path(spark, "registry")
    Registry(spark, folder).add_dataset(orders.limit(0), "Orders")
    name = Registry(spark, folder).add_dataset(orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "Orders")
    later = Registry(spark.newSession(), folder)
    later.delete("dataset", "Orders")
    return later.dataset(name).withColumn("name", F.lit(later.active("dataset").name))


@query("model_registry_fit", "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{t}', {n}, true)" for t, n in (("classification", 4), ("regression", 3))
    for m in model_registry.model_options(t)) + ") AS t(model, task, n_metrics, learned)")
def q_model_registry_fit(spark, d):
    """Every registry model fitted on lineitem: its metrics, and whether they show
    that it has learned (shares above 0.9; R squared above 0.9).

    The fits are independent, so they run as concurrent Spark jobs from a
    few driver threads; the models of a task share its split and preprocessing.
    """
    from concurrent.futures import ThreadPoolExecutor
    lines = signal_lines(spark, d)
    jobs, prepared = [], {}
    for task, target, feats in (("classification", "l_band", CLS_FEATURES),
                                ("regression", "l_charge", REG_FEATURES)):
        for name in model_registry.model_options(task):
            params = {"n_estimators": 10, "max_depth": 5} if "Forest" in name else \
                     {"n_estimators": 10, "learning_rate": 0.3} if "Gradient" in name else \
                     {"n_components": 100} if name in ("SVC", "SVR") else {}
            jobs.append((name, task, target, feats, params))

    def fit(job):
        name, task, target, feats, params = job
        got = trainer.train_model(lines, feats, target, name, task, params, key_cols=LINE_KEYS,
                                  prepared=prepared[task]).metrics
        fine = all(0.9 < v <= 1 for v in got.values()) if task == "classification" else \
            got["rmse"] >= got["mae"] >= 0 and 0.9 < got["r2"] <= 1
        return name, task, len(got), bool(fine)

    def prepare(job):
        _, task, target, feats, _ = job
        prepared[task] = trainer.prepare_training(lines, feats, target, task, LINE_KEYS)

    try:
        with ThreadPoolExecutor(max_workers=4) as pool:
            list(pool.map(prepare, {job[1]: job for job in jobs}.values()))
            rows = list(pool.map(fit, jobs))
    finally:
        for each in prepared.values():
            each.release()
    return spark.createDataFrame(rows, "model string, task string, n_metrics int, learned boolean")


# ------------------------------------------------------------------- sources --

from ..sources import csv as csv_io  # noqa: E402
from ..sources import files as file_io  # noqa: E402


def _round_trip_csv(spark, df, name):
    path = f"{scratch_path(spark, 'csv')}/{name}"
    csv_io.write_csv(df, path)
    return path


@query("read_csv_inferred", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_read_csv_inferred(spark, d):
    path = _round_trip_csv(spark, read(spark, d, "customer"), "customer.csv")
    return file_io.load_table(spark, path)


@query("read_csv_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
       o_orderpriority FROM orders""")
def q_read_csv_orders(spark, d):
    path = _round_trip_csv(spark, read(spark, d, "orders"), "orders.csv")
    return csv_io.read_csv(spark, path)


@query("read_many", """
SELECT 'customer.csv' AS name, count(*) AS n_rows, 5 AS n_cols FROM customer
UNION ALL SELECT 'nation.csv', count(*), 3 FROM nation
UNION ALL SELECT 'orders.csv', count(*), 6 FROM orders""")
def q_read_many(spark, d):
    root = scratch_path(spark, "many")
    paths = []
    for t in ("nation", "customer", "orders"):
        paths.append(f"{root}/{t}.csv")
        csv_io.write_csv(read(spark, d, t), paths[-1])
    loaded, errors = file_io.load_many(spark, paths + [f"{root}/notes.txt"])
    assert "notes.txt" in errors
    parts = [df.groupBy().count().select(F.lit(name).alias("name"), F.col("count").alias("n_rows"),
                                         F.lit(len(df.columns)).alias("n_cols"))
             for name, df in loaded.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# A blank header, numbers with leading blanks, NA
# spellings, quoted line breaks, and doubles of every size.
_DIRTY_CSV = ["l_orderkey AS id", "CASE WHEN l_linenumber % 3 = 0 THEN concat('a', chr(10), '\"b\"') "
              "WHEN l_linenumber % 3 = 1 THEN 'n/a' ELSE l_returnflag END AS note",
              "concat('  ', l_partkey) AS part", "l_extendedprice / 1e9 AS small", "l_extendedprice * 1e12 AS large"]


@query("read_csv_dirty", f"""
SELECT l_orderkey AS "Unnamed: 0",
       CASE WHEN l_linenumber % 3 = 0 THEN 'a' || chr(10) || '"b"' WHEN l_linenumber % 3 = 1 THEN NULL
            ELSE l_returnflag END AS note,
       l_partkey AS part, l_extendedprice / 1e9 AS small, l_extendedprice * 1e12 AS large FROM lineitem""")
def q_read_csv_dirty(spark, d):
    """lineitem as a messy file: a blank header, leading blanks, line breaks in quotes."""
    rows = read(spark, d, "lineitem").selectExpr(*_DIRTY_CSV).toDF("", "note", "part", "small", "large")
    path = f"{scratch_path(spark, 'csv')}/lines.csv"
    csv_io.write_csv(rows, path)
    return csv_io.read_csv(spark, path)


# ----------------------------------------------------------------- streaming --

from .. import streaming  # noqa: E402


@query("stream_clean", """
SELECT event_id, ts, user_id, event_type, value, props,
       lpad(CAST(user_id AS VARCHAR), 4, '0') || ':' || event_type AS user_event,
       CASE WHEN value > 50 THEN 1 ELSE 0 END AS high_value
FROM events
WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def q_stream_clean(spark, d):
    """events read as a stream, cleaned row by row, written as parquet, read back."""
    src = read(spark, d, "events")
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    steps = [
        lambda df: clean.time_range(df, "ts", "2024-01-03", "2024-01-20", strict=False),
        lambda df: clean.combine_columns(df, "user_event", "user_id", "event_type", ":", 4, 0),
        lambda df: agg.binary_flag(df, "value", 50, "high_value"),
    ]
    stream = streaming.read_stream(spark, d, src.schema, glob="events.parquet")
    streaming.clean_stream(stream, steps, out, ckpt)
    return spark.read.parquet(out)


@query("stream_train", f"""
SELECT count(*) AS n_rows, 0 AS n_null, true AS learned, {_N_TRAIN} + count(*) AS rows_seen FROM lineitem""")
def q_stream_train(spark, d):
    """An incremental regressor continued on each micro-batch of lineitem, and
    once more after a restart that finds nothing new: every row counts once."""
    model, _ = _first_pass(spark, d)
    lines = read(spark, d, "lineitem")
    models, marks = scratch_path(spark, "stream-model"), scratch_path(spark, "stream-train-ckpt")
    for _ in range(2):
        stream = with_targets(streaming.read_stream(spark, d, lines.schema, glob="lineitem.parquet"))
        _, holder = streaming.train_on_stream(stream, model, models, marks)
    return _pass_facts(spark, d, holder["model"]).drop("passes")
