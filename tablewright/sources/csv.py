"""CSV in and out with spreadsheet semantics.

Reading: every field is read as text (header row, quoted newlines, doubled
quotes; blank headers are named by place), the usual NA tokens become null, and each column gets the
narrowest type that every present value parses as — integer, then float,
then boolean, else text — decided by one aggregation over the whole input
(per column: present values, and how many parse as each type). Dates stay
text. Duplicate header names get ``.1``, ``.2`` suffixes.

Writing: header row, null as an empty field, values rendered the way the
reader (and a spreadsheet user) expects (``10000000.0``, ``True``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_text
from . import records

# Text read as missing (the common spreadsheet/pandas list).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")
# Text read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# Numbers may have blanks around them.
_INT = r"^ *[+-]?[0-9]+ *$"
_FLOAT = r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$|^ *[+-]?(?i:inf|infinity) *$"
_BROKEN = "_broken_record"
_PARSER = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": _BROKEN,
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def dedupe_names(names) -> list[str]:
    """``a, b, b`` → ``a, b, b.1`` (skipping suffixes already taken); a blank
    name at place ``i`` becomes ``Unnamed: i``."""
    seen: set[str] = set()
    out = []
    for at, raw in enumerate(names):
        name = str(raw) if raw is not None and str(raw) != "" else f"Unnamed: {at}"
        if name in seen:
            i = 1
            while f"{name}.{i}" in seen:
                i += 1
            name = f"{name}.{i}"
        seen.add(name)
        out.append(name)
    return out


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("multiLine", multi_line).option("escape", '"').option("quote", '"')
            .option("inferSchema", False).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).option("mode", "PERMISSIVE"))


def _too_long(record: Column, fields: str) -> Column:
    """Whether a record that has not as many fields as declared (else null) has
    more: then a mark put behind its end is in none of the declared fields."""
    mark = F.md5(record.cast("binary"))
    read = F.from_csv(F.concat(record, F.lit(","), mark), fields, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    text = F.to_json(read)
    return F.when(record.isNotNull(), ~F.coalesce(F.contains(text, mark), F.lit(False))).otherwise(F.lit(False))


def read_csv_text(spark: SparkSession, paths, multi_line: bool | None = None) -> DataFrame:
    """All columns as text with NA tokens turned into null, header names de-duplicated.

    Files are read in blocks, also where quoted fields run over line ends: one
    pass finds whether they do and which state a block begins in (see
    :mod:`.records`). ``multi_line`` false says that they do not, and saves that
    pass; true reads every file in one task, which is also done where lines end
    in a carriage return alone.

    A path's part files share one header; several paths must have the same
    columns, in any order. A record with more fields than its header is an
    error, one with fewer has nulls.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    maps = []
    if multi_line is None:
        maps = records.block_maps(spark, paths) if records.has_quotes(spark, paths) else []
        multi_line = any(m["spans"] or m["bare"] for m in maps)
    joined = multi_line and bool(maps) and not any(m["bare"] for m in maps)
    parts, columns = [], None
    for path in paths:
        first = _reader(spark, multi_line).option("header", False).csv(path).first()
        names = dedupe_names(first) if first is not None else []
        if columns is None:
            columns = names
        elif sorted(names) != sorted(columns):
            raise ValueError(f"{path!r} has columns {names}, but {paths[0]!r} has {columns}.")
        if not names:
            continue
        # positional names: those of the file may repeat
        fields = ", ".join(f"`c{i}` string" for i in range(len(names)))
        whole = f"{fields}, `{_BROKEN}` string"
        if joined:
            found = records.records(spark, path, maps).where("not head")
            raw = found.select(F.from_csv("record", whole, _PARSER).alias("r")).select("r.*")
        else:
            raw = (_reader(spark, multi_line).option("header", True).option("enforceSchema", True)
                   .option("columnNameOfCorruptRecord", _BROKEN).schema(whole).csv(path))
        kept = raw.withColumn(_BROKEN, _too_long(F.col(_BROKEN), fields))
        parts.append(kept.toDF(*names, _BROKEN).select(*[F.col(f"`{c}`") for c in columns], _BROKEN))
    if not parts:
        return spark.createDataFrame([], "")
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    # Checked where the rows are read: no record is cut silently.
    whole = F.when(F.col(_BROKEN), F.raise_error(F.lit(
        f"A record of {', '.join(paths)} has more fields than the {len(columns)} of its header.")).cast("string"))
    values = [F.when(F.col(f"`{c}`").isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(f"`{c}`"))
              for c in columns]
    values[0] = F.coalesce(whole, values[0])
    return df.select([v.alias(c) for v, c in zip(values, columns)])


def _parse_counts(c: Column):
    present = c.isNotNull()
    as_long = F.btrim(c).try_cast("bigint")
    is_int = present & c.rlike(_INT) & as_long.isNotNull()
    is_float = present & c.rlike(_FLOAT)
    is_bool = present & c.isin(*TRUE_TOKENS, *FALSE_TOKENS)
    return present, is_int, is_float, is_bool


def infer_types(df: DataFrame) -> dict[str, str]:
    """One aggregation over all rows: the narrowest type per text column."""
    aggs = []
    for i, name in enumerate(df.columns):
        present, is_int, is_float, is_bool = _parse_counts(F.col(f"`{name}`"))
        aggs += [F.count(F.when(present, 1)).alias(f"p{i}"), F.count(F.when(is_int, 1)).alias(f"i{i}"),
                 F.count(F.when(is_float, 1)).alias(f"f{i}"), F.count(F.when(is_bool, 1)).alias(f"b{i}")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    types = {}
    for i, name in enumerate(df.columns):
        p = row[f"p{i}"]
        if p == 0:
            types[name] = "double"          # an all-empty column reads as float NaN
        elif row[f"i{i}"] == p:
            types[name] = "bigint"
        elif row[f"f{i}"] == p:
            types[name] = "double"
        elif row[f"b{i}"] == p:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cols = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        kind = types.get(name, "string")
        if kind == "bigint":
            cols.append(F.btrim(c).try_cast("bigint").alias(name))
        elif kind == "double":
            low = F.lower(F.btrim(c))
            cols.append(F.when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
                        .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
                        .otherwise(F.btrim(c).try_cast("double")).alias(name))
        elif kind == "boolean":
            cols.append(F.when(c.isin(*TRUE_TOKENS), F.lit(True))
                        .when(c.isin(*FALSE_TOKENS), F.lit(False)).alias(name))
        else:
            cols.append(c.alias(name))
    return df.select(cols)


def read_csv(spark: SparkSession, paths, multi_line: bool | None = None) -> DataFrame:
    """Read CSV file(s) with whole-input type inference (one extra aggregation job)."""
    text = read_csv_text(spark, paths, multi_line)
    return apply_types(text, infer_types(text))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Write a header CSV directory (one part file per partition, or one file).

    Null becomes an empty field; quotes inside values are doubled.
    ``single_file`` funnels all rows through one task: only for small results.
    """
    rendered = df.select([as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    if single_file:
        rendered = rendered.coalesce(1)
    (rendered.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"')
     .option("emptyValue", "").option("nullValue", "").csv(path))
