"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tallyhound import catalogue

DATA = "/root/testdata/sf0.001"
SLOW = {"plumbing_closure", "stream_session_counts", "stream_policy", "verdicts_of_lines"}  # run on their own below


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE) - SLOW))
def test_against_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = db.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["plumbing_closure", "stream_session_counts", "stream_policy", "verdicts_of_lines"])
def test_slow_ones_against_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = db.execute(catalogue.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_policy_queries_give_alerts(spark):
    batch = catalogue.QUERIES["policy_alerts"](spark, DATA)
    assert {r.event for r in batch.select("event").distinct().collect()} >= {"info", "agent_declared", "freeze_violation"}
    stream = catalogue.QUERIES["stream_policy"](spark, DATA)
    assert {r.event for r in stream.select("event").distinct().collect()} >= {"agent_declared", "agent_high", "agent_ended"}
