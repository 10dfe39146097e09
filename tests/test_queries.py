"""Every registered query with SQL against DuckDB on the smallest data folder."""

import glob
import math
import os

import duckdb
import pytest

import loomscope.queries as core

DATA = "/root/testdata/sf0.001"


def tidy(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    rel = duck.execute(core.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(tidy(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=str)
    got = sorted((tuple(tidy(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_slices_add_up(spark):
    rows = core.QUERIES["center_acc_by_device"](spark, DATA).collect()
    for model in {r.model for r in rows}:
        parts = [r.n for r in rows if r.model == model]
        assert sum(parts) == 2 * max(parts)


def test_complete_is_at_most_partial(spark):
    r = core.QUERIES["episode_success"](spark, DATA).first()
    assert r.complete <= r.partial
