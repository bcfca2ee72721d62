"""The driver contract: entry() runs, and every registered query equals its
DuckDB oracle on sf0.001 (row count, column names, values)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from helpers import SF_SMALL
from flotilla.plans.catalog import QUERIES
from flotilla.plans.oracles import oracle_sql
from flotilla.sources.tables import TABLES


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["deployment_id", "tier", "idx", "shard", "private_ip", "port"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(entry_mod.queries()) and set(oracle_sql()) <= set(entry_mod.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _canon(df.columns, got) == _canon(ocols, want)


def test_entry_without_the_training_data_package(monkeypatch):
    """The optional package may be missing; a broken import inside it may not pass unseen."""
    import builtins
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name=missing.name)
        return real(name, *args, **kwargs)
    monkeypatch.setattr(builtins, "__import__", missing)
    missing.name = "corpus_pipeline"
    assert set(entry_mod.queries()) == set(QUERIES)
    missing.name = "numpy"
    with pytest.raises(ModuleNotFoundError):
        entry_mod.queries()
