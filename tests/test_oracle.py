"""Each registered query against its SQL twin, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


def registered():
    from quizloom.plans import queries_corpus, queries_jobs, queries_practice

    return [(n, f, m.ORACLE.get(n)) for m in (queries_practice, queries_corpus, queries_jobs) for n, f in m.QUERIES.items()]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}" if v != v.to_integral() else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name,query,sql", [pytest.param(*x, id=x[0]) for x in registered()])
def test_query(spark, db, name, query, sql):
    df = query(spark, SF)
    got = df.collect()
    if sql is None:
        assert len(df.columns) > 0
        return
    found = db.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, got) == rows(found.columns, found.fetchall())
