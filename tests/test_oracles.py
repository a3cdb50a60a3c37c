"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from quarry.plans import registry

D = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.execute(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, D)
    rows, sql = df.collect(), registry.oracle_sql().get(name)
    assert rows
    if sql is None:
        return
    want = duck.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(norm(r[n]) for n in names) for r in rows), key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["retrieve_hybrid", "query_fanout"])
def test_text_without_a_vector(spark, tmp_path, name):
    """A document with no token has a vector without length, of which the SQL's cosine is NaN."""
    c = duckdb.connect()
    c.execute(f"copy (select doc_id, text, lang, source from '{D}/documents.parquet' union all select 100000 + i, '', null, null from range(2) t(i)) to '{tmp_path}/documents.parquet'")
    c.execute(f"copy (from '{D}/benchmark.parquet' order by item_id limit 12) to '{tmp_path}/benchmark.parquet'")
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    df, want = registry.queries()[name](spark, str(tmp_path)), c.sql(registry.oracle_sql()[name])
    at = [want.columns.index(n) for n in df.columns]
    rows = [tuple(map(norm, r)) for r in df.collect()]
    assert any(r[1] >= 100000 for r in rows)
    assert sorted(rows, key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_flagship(spark):
    rows = registry.flagship(spark, D).collect()
    assert len(rows) == 40 and all("[S1]" in r["answer"] for r in rows)
