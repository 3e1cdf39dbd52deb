"""The driver's contract, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_flagship(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_own_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    from reportloom.plans.oracles import ORACLE_SQL
    from reportloom.plans.queries import QUERIES

    assert set(ORACLE_SQL) == set(QUERIES)
    con = duckdb.connect()
    for name in ("labels", "documents", "orders", "part", "events", "lineitem", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    plain = lambda v: "null" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name, query in QUERIES.items():
        df = query(spark, DATA)
        names = sorted(df.columns)
        got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
        found = con.execute(ORACLE_SQL[name])
        at = [c[0] for c in found.description]
        assert sorted(at) == names, name
        want = sorted(tuple(plain(r[at.index(n)]) for n in names) for r in found.fetchall())
        assert got == want, name
