"""Every registered query of the core against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from timelode.plans import chunking, code, documents, enrich, intervals, maintenance, pipeline, retrieval, timeline

DATA = os.environ.get("TIMELODE_TEST_DATA", "/root/testdata/sf0.001")
MODULES = (intervals, timeline, enrich, chunking, code, retrieval, documents, maintenance, pipeline)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: q for m in MODULES for n, q in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in SQL:
        assert columns
        return
    result = oracle.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_entry_names_are_unique():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) and set(SQL) <= set(QUERIES)
