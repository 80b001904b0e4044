"""Audit records over micro-batches give the events that a batch gives."""

import pytest

from pyspark.sql import functions as F

from tallyhound.sources import audit_log
from tallyhound.streaming import audit, live


def record(serial, kind, body, at=0.0):
    return f"type={kind} msg=audit({1789380000 + at:.3f}:{serial}): {body}"


def call(serial, cmd, at=0.0, end=None):
    args = " ".join(f'a{k}="{a}"' for k, a in enumerate(cmd.split()))
    out = [record(serial, "SYSCALL", f'arch=c000003e syscall=59 success=yes ppid=51 pid={900 + serial} uid=1000 ses=5 comm="x" exe="/usr/bin/x"', at), record(serial, "EXECVE", f"argc={len(cmd.split())} {args}", at), record(serial, "CWD", 'cwd="/srv"', at)]
    return out + [record(serial, end, "" if end == "EOE" else 'proctitle="x"', at)] if end else out


LOGIN = record(90, "USER_LOGIN", "pid=50 uid=0 auid=1000 ses=5 msg='op=login acct=\"ann\" exe=\"/usr/sbin/sshd\" hostname=? addr=10.0.0.3 terminal=ssh res=success'", 6.0)
one, two, three, four, five = call(7, "ls -l", 0, "PROCTITLE"), call(8, "cat a b", 0.5, "EOE"), call(9, "make all", 1), call(20, "id", 5), call(21, "date", 5.5, "EOE")
#: Lines as they come: interleaved, a group cut by a batch's end, a group that only time closes, lines that are none.
BATCHES = [
    [one[0], two[0], one[1], two[1], "noise", three[0], one[2], one[3], two[2]],
    [two[3], three[1], three[2], *four[:2]],
    [four[2], five[3], five[1], five[0], five[2], LOGIN],
    [*call(400, "end", 100, "EOE")],  # far ahead: what is open is old by then
    [record(401, "CWD", 'cwd="/"', 200)],
]


@pytest.fixture(scope="module")
def known(spark):
    return lambda df: sorted((r.host, r.kind, r.ts, r.user, r.pid, r.ses, sorted(r.fields.items())) for r in df.collect())


def test_batches_cut_anywhere_give_the_batch_events(spark, tmp_path, known):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    audit.with_states(spark)
    try:
        spark.createDataFrame([], "host string, value string").write.parquet(str(tmp_path / "in"))
        for k, lines in enumerate(BATCHES):
            spark.createDataFrame([(h, x) for x in lines for h in ("web", "db")], "host string, value string").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
            logs = spark.readStream.schema("host string, value string").parquet(str(tmp_path / "in"))
            alone, calls = audit.parts(logs, late="3 seconds")  # each round starts the queries anew from their checkpoints
            live.run_once(calls, str(tmp_path / "calls"), str(tmp_path / "c1"))
            live.run_once(alone, str(tmp_path / "alone"), str(tmp_path / "c2"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "calls")).unionByName(spark.read.parquet(str(tmp_path / "alone")))
    whole = spark.createDataFrame([(x,) for lines in BATCHES for x in lines], "value string")
    want = audit_log.events(whole)
    want = want.crossJoin(spark.createDataFrame([("web",), ("db",)], "host string"))
    assert known(got) == known(want) and len(known(got)) == 14
    assert {r.fields["cmd"] for r in got.filter(F.col("kind") == "audit.execve").collect()} == {"ls -l", "cat a b", "make all", "id", "date", "end"}
