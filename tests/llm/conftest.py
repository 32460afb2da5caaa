import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_frame(spark):
    """Build a ``documents`` frame from (doc_id, text[, lang, source]) rows,
    with further columns whose names the operators use inside."""
    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:
            df = df.selectExpr("*", "1 as `row`", "'x' as `class`", "2 as n", "3 as `token`", "4 as `key`",
                               "5 as size", "6 as task", "7 as keep_id", "8 as words", "'y' as kept")
        return df
    return build


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
