import os
import random

import pytest

from tablewright.sources import Catalog, csv as csv_io, files, unique_name

CSV_TEXT = 'a,b,b,c,d\n1,x,None,2024-01-01,True\n,NA,null,n/a,False\n007,"q""z","m\nn",,\n'


def test_csv_fixture(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w") as fh:
        fh.write(CSV_TEXT)
    df = files.load_table(spark, path)
    assert df.columns == ["a", "b", "b.1", "c", "d"]
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "string", "b.1": "string", "c": "string", "d": "boolean"}
    rows = [tuple(r) for r in df.collect()]
    assert rows == [(1, "x", None, "2024-01-01", True), (None, None, None, None, False),
                    (7, 'q"z', "m\nn", None, None)]


def test_dedupe_names():
    assert csv_io.dedupe_names(["a", "a", "a.1", "a"]) == ["a", "a.1", "a.1.1", "a.2"]


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, 1e7, "x,y", True, None), (2, 0.5, 'he said "hi"', False, "z")],
                               "i long, f double, s string, b boolean, n string")
    path = os.path.join(tmp_dir, "out.csv")
    files.save_table(df, path)
    text = "".join(open(os.path.join(path, p)).read() for p in sorted(os.listdir(path)) if p.endswith(".csv"))
    assert "10000000.0" in text and "True" in text and '"he said ""hi"""' in text
    back = files.load_table(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_extension_checks(spark):
    with pytest.raises(ValueError, match="Cannot read"):
        files.load_table(spark, "/tmp/x.parquet")
    with pytest.raises(ValueError):
        files.load_table(spark, "/tmp/x.xls")
    with pytest.raises(ValueError, match="Cannot write"):
        files.save_table(spark.range(1), "/tmp/x.json")


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as fh:
        fh.write(text)
    return path


def test_csv_blank_headers_and_blanks(spark, tmp_dir):
    path = _write(tmp_dir, "t.csv", ",n,,x\n0, 5,a, 1.5 \n1,7 ,b,2\n2,,c,\n")
    df = files.load_table(spark, path)
    assert dict(df.dtypes) == {"Unnamed: 0": "bigint", "n": "bigint", "Unnamed: 2": "string", "x": "double"}
    assert [tuple(r) for r in df.collect()] == [(0, 5, "a", 1.5), (1, 7, "b", 2.0), (2, None, "c", None)]


def test_csv_long_record_is_an_error(spark, tmp_dir):
    path = _write(tmp_dir, "t.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more fields"):
        files.load_table(spark, path)
    short = files.load_table(spark, _write(tmp_dir, "s.csv", "a,b\n1,2\n3\n"))
    assert [tuple(r) for r in short.collect()] == [(1, 2), (3, None)]


@pytest.mark.parametrize("record", ["1,2,,x", "1,2,", "1,2,,", '1,2,"",x', '"1,""",2,,"x\ny"', ",,,"])
def test_csv_long_record_with_empty_surplus(spark, tmp_dir, record):
    path = _write(tmp_dir, "t.csv", f"a,b\n1,2\n{record}\n")
    with pytest.raises(Exception, match="more fields"):
        csv_io.read_csv_text(spark, path).collect()


@pytest.mark.parametrize("multi_line", [False, True])
def test_csv_short_records_are_no_error(spark, tmp_dir, multi_line):
    path = _write(tmp_dir, "t.csv", 'a,b,c\n1,2,3\n"x,y"\n"p ""q"",",r\n,\n7\n,,\n')
    got = csv_io.read_csv_text(spark, path, multi_line).collect()
    assert [tuple(r) for r in got] == [("1", "2", "3"), ("x,y", None, None), ('p "q",', "r", None),
                                       (None, None, None), ("7", None, None), (None, None, None)]


def test_csv_files_of_another_column_order(spark, tmp_dir):
    one, two = _write(tmp_dir, "1.csv", "a,b\n1,x\n"), _write(tmp_dir, "2.csv", "b,a\ny,2\n")
    got = csv_io.read_csv(spark, [one, two])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="columns"):
        csv_io.read_csv(spark, [one, _write(tmp_dir, "3.csv", "a,c\n1,2\n")])


def test_csv_without_line_breaks_in_quotes_is_split(spark, tmp_dir):
    path = _write(tmp_dir, "big.csv", "a,b\n" + "".join(f"{i},\"q {i}\"\n" for i in range(20_000)))
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = files.load_table(spark, path)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_doubles_survive_the_round_trip(spark, tmp_dir):
    rng = random.Random(1)
    values = [0.00012345678901234567, 1e-4, 9.999999999999999e-4, 1e16, 1.5e300, 5e-324, 0.1 + 0.2, 123456789012345.67]
    values += [rng.uniform(1, 10) * 10.0 ** rng.randint(-30, 30) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    path = os.path.join(tmp_dir, "d.csv")
    files.save_table(df, path)
    assert {r.i: r.v for r in files.load_table(spark, path).collect()} == dict(enumerate(values))


def test_load_many_reports_errors(spark, tmp_dir):
    good = os.path.join(tmp_dir, "a.csv")
    with open(good, "w") as fh:
        fh.write("x\n1\n")
    loaded, errors = files.load_many(spark, [good, os.path.join(tmp_dir, "b.txt")])
    assert list(loaded) == ["a.csv"] and "b.txt" in errors


def test_catalog(spark):
    cat = Catalog(spark)
    a = cat.register(spark.range(3), "Merged Inner x + y")
    b = cat.register(spark.range(4), "Merged Inner x + y")
    assert (a, b) == ("Merged Inner x + y", "Merged Inner x + y_2")
    assert spark.sql(f"SELECT count(*) FROM {cat.view(b)}").first()[0] == 4
    assert cat.columns(a) == ["id"]
    cat.drop(a)
    assert cat.names() == [b]
    with pytest.raises(ValueError):
        cat.get(a)
    assert unique_name("m", ["m", "m_2"]) == "m_3"


def test_catalog_views_are_apart(spark):
    cat = Catalog(spark)
    one, two = cat.register(spark.range(5), "a b"), cat.register(spark.range(1), "a_b")
    count = lambda name: spark.sql(f"SELECT count(*) FROM {cat.view(name)}").first()[0]
    assert (count(one), count(two)) == (5, 1)
    cat.drop(two)
    assert count(one) == 5 and cat.names() == [one]


def test_catalog_default_names(spark):
    cat, df = Catalog(spark), spark.range(1)
    assert cat.register_merge(df, "inner", "x.csv", "/d/y.csv") == "Merged Inner x + y"
    assert cat.register_merge(df, "inner", "x.csv", "/d/y.csv") == "Merged Inner x + y_2"
    assert cat.register_aggregate(df, "x.csv") == "Aggregated x" and cat.register_aggregate(df, "x", " sums ") == "sums"
    assert cat.register_prediction(df, None) == "Predicted Dataset"
    assert cat.register_range(df, "x.csv", "ts", "2024-01-01", "") == "x ts 2024-01-01 To End"


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from tablewright import session

    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Remote)
