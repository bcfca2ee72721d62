"""Registered queries against their SQL, and that all are registered."""

import os

import __spark_entry__ as entry_mod
import corpus_pipeline
import duckdb
import pytest
from flotilla.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


def test_registered():
    found = entry_mod.queries()
    assert set(QUERIES) <= set(found) and found["pipeline"] is corpus_pipeline.run
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(names)
    got = [tuple(r) for r in got.select(*names).collect()]
    assert len(got) == len(want)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
