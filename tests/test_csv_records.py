"""Records over line ends in split files, against Python's own CSV reader."""

import csv
import io
import random

import pytest

from tablewright.sources import csv as csv_io
from tablewright.sources import records


def state_by_machine(line, inside):
    """Where a line ends, character by character."""
    at_start, i = True, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    inside, at_start = False, False
        elif c == ",":
            at_start = True
        elif c == '"' and at_start:
            inside = True
        else:
            at_start = False
        i += 1
    return inside


def test_line_maps_match_a_state_machine():
    rng = random.Random(1)
    for _ in range(30_000):
        line = "".join(rng.choice('",a\r') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            assert records.ends_inside(line, inside) == state_by_machine(line, inside), (line, inside)


def test_long_lines_and_many_quotes():
    assert records.ends_inside("a," * 100_000 + '"x', False)
    assert not records.ends_inside('"' + '""' * 100_000 + '"', False)
    assert records.ends_inside('""' * 100_000, True)


def some_rows(n, seed=2):
    rng = random.Random(seed)
    texts = ["plain", 'say "hi"', "two\nlines", 'a\n\n"b"\n', ",", "5' tall", "", "x" * 300, "cr\r\nlf", "\n" * 40, '"']
    return [[str(i), rng.choice(texts), rng.choice(texts), "end"] for i in range(n)]


def write(path, rows, ending="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows([["id", "a", "b", "c"], *rows])
    with open(path, "w", newline="") as f:
        f.write(out.getvalue())


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_split_file_is_read_in_several_tasks(spark, tmp_dir, small_splits, ending):
    rows = some_rows(700)
    path = f"{tmp_dir}/x.csv"
    write(path, rows, ending)
    maps = records.block_maps(spark, [path])
    assert len(maps) > 20 and any(records.first_states(maps).values())
    df = csv_io.read_csv_text(spark, path)
    assert df.rdd.getNumPartitions() > 4
    want = sorted([[v or None for v in r] for r in rows], key=lambda r: int(r[0]))
    assert sorted(([r["id"], r["a"], r["b"], r["c"]] for r in df.collect()), key=lambda r: int(r[0])) == want


def test_record_longer_than_many_blocks(spark, tmp_dir, small_splits):
    rows = [["1", "x", "y", "z"], ["2", "line of text\n" * 2000, 'q"', "z"], ["3", "a\nb", "y", "z"]]
    path = f"{tmp_dir}/x.csv"
    write(path, rows)
    got = sorted(tuple(r) for r in csv_io.read_csv_text(spark, path).collect())
    assert got == [tuple(r) for r in rows]


def test_several_files_with_headers_over_lines(spark, tmp_dir, small_splits):
    import os
    os.mkdir(f"{tmp_dir}/d")
    for k in range(3):
        with open(f"{tmp_dir}/d/{k}.csv", "w") as f:
            f.write('\n"i\nd",note\n' + "".join(f'{k}{i},"a\n{i}"\n\n' for i in range(200)))
    df = csv_io.read_csv_text(spark, f"{tmp_dir}/d")
    assert df.columns == ["i\nd", "note"] and df.count() == 600
    assert {r["note"] for r in df.collect()} == {f"a\n{i}" for i in range(200)}


def test_stray_quote_in_a_plain_field_keeps_lines_apart(spark, tmp_dir):
    path = f"{tmp_dir}/x.csv"
    with open(path, "w") as f:
        f.write('id,size\n1,5" pipe\n2,7\n3,a"b"c"\n')
    assert not any(m["spans"] for m in records.block_maps(spark, [path]))
    assert [tuple(r) for r in csv_io.read_csv_text(spark, path).orderBy("id").collect()] == [
        ("1", '5" pipe'), ("2", "7"), ("3", 'a"b"c"')]


def test_over_long_record_over_lines_is_an_error(spark, tmp_dir):
    path = f"{tmp_dir}/x.csv"
    for tail in ('2,"x\ny",z\n', '2,"x\ny",\n'):
        with open(path, "w") as f:
            f.write('id,a\n1,"p\nq"\n' + tail)
        with pytest.raises(Exception, match="more fields than"):
            csv_io.read_csv_text(spark, path).collect()
    with open(path, "w") as f:
        f.write('id,a\n1,"p\nq"\n2\n')
    assert [tuple(r) for r in csv_io.read_csv_text(spark, path).orderBy("id").collect()] == [("1", "p\nq"), ("2", None)]


def test_lines_that_end_in_a_carriage_return_alone(spark, tmp_dir):
    path = f"{tmp_dir}/x.csv"
    with open(path, "w", newline="") as f:
        f.write('id,a\r1,"p\rq"\r2,z\r')
    assert csv_io.read_csv_text(spark, path).count() == 2


def test_lines_are_walked_in_batches_and_blocks_without_open_ends_once(spark, tmp_dir, monkeypatch):
    """Only lines that hold quotes are looked at one by one, and only blocks that
    begin or end inside quotes are read for pieces."""
    rows = some_rows(3000, 7)
    write(f"{tmp_dir}/w.csv", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        maps = records.block_maps(spark, f"{tmp_dir}/w.csv")
        states = records.first_states(maps)
        crossed = sum(states[m["file"], m["block"]] or m["outside"] for m in maps)
        assert 0 < crossed < len(maps)
        found = records.records(spark, f"{tmp_dir}/w.csv", maps)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan
        texts = [r.record for r in found.where("not head").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted(next(csv.reader(io.StringIO(t, newline=""))) for t in texts)
    assert got == sorted(rows)
    import numpy as np
    import pyarrow as pa
    asked, ends_inside = [], records.ends_inside
    monkeypatch.setattr(records, "ends_inside", lambda line, inside: asked.append(line) or ends_inside(line, inside))
    line = pa.array(["a,b", '1,"x', "y", 'z",2', "c"])
    assert records._open_after(line, False).tolist() == [False, True, True, False, False]
    assert asked == ['1,"x', 'z",2']
    assert records._joined(line, np.array([1, 4, 5])).to_pylist() == ["a,b", '1,"x\ny\nz",2', "c"]


def test_doubles_print_as_python_does_with_few_patterns(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from tablewright.functions import as_text
    rng = random.Random(4)
    values = [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(500)]
    values += [1e16, 1e-5, 1e22, 1.5e300, -2e-300, 1e-4, 123456789012345.0, 0.0, 1e7, -1e15, 2.5e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    text = as_text(F.col("v"), df.schema["v"].dataType)

    def printed(v, raw):
        """Java's digits (it may write one too many) in Python's form."""
        if "E" not in raw:
            return raw
        if 1e-4 <= abs(v) < 1e16:
            plain = format(Decimal(raw).normalize(), "f")
            return plain if "." in plain else plain + ".0"
        mantissa, exponent = raw.split("E")
        return f"{mantissa.removesuffix('.0')}e{int(exponent):+03d}"

    got = df.select("v", F.col("v").cast("string").alias("raw"), text.alias("t")).collect()
    assert [r.t for r in got] == [printed(r.v, r.raw) for r in got] and all(float(r.t) == r.v for r in got)
    assert sum(r.t == repr(r.v) for r in got) > 400
    assert "regexp_extract" not in str(text)  # four searches a value before
