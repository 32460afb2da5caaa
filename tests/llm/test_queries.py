"""Every query of the package against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from tablewright.llm.registered import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    num = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([num(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    assert tidy(df.columns, [tuple(r) for r in df.collect()]) == tidy([d[0] for d in want.description], want.fetchall())


def test_one_query_per_operator():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
