"""Every query of the library against its SQL on the smallest tables."""

import decimal
import os

import pytest

from lexmill import queries as library

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql(tables):
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tables}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(library.queries()))
def test_query(spark, tables, sql, name):
    df = library.queries()[name](spark, tables)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in library.oracle_sql():
        assert got
        return
    cursor = sql.execute(library.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "bm25_topk" in e.queries()
    assert e.entry(spark).columns == ["query_id", "doc_id", "score", "place"]
