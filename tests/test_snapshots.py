"""Scans to events: a fixture by hand, and the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import snapshots
from tallyhound.sources import rules
from tallyhound.streaming import audit, live, scans

SECOND = 1_000_000
STAT = "{pid} ({comm}) S 50 1 1 34817 1 0 0 0 0 0 0 0 0 0 20 0 1 0 {start} 0 0"
RAW = "host string, at long, pid int, stat string, cmdline string, exe string, environ string, uid int, loginuid int, ses int, user string"


def raw(at, pid, comm, start=1, cmdline="", env="", uid=1000, loginuid=1000, ses=5, user="ann", host="web"):
    return (host, at * SECOND, pid, STAT.format(pid=pid, comm=comm, start=start), cmdline.replace(" ", "\0") + "\0", f"/usr/bin/{comm}", env, uid, loginuid, ses, user)


SCANS = {
    0: [raw(0, 10, "claude", cmdline="claude --dangerously-skip-permissions"), raw(0, 11, "bash"), raw(0, 12, "python3", env="AI_AGENT=helper\0HOME=/x\0"), raw(0, 13, "daemon", env="AI_AGENT=x\0", uid=5, loginuid=-1)],
    30: [raw(30, 10, "claude"), raw(30, 12, "python3", start=9, env="AI_AGENT=bad name\0")],
    61: [raw(61, 10, "claude"), raw(61, 14, "x\x1b[31mred", cmdline="x --yolo")],
    70: [],
    80: [raw(80, 10, "claude"), raw(80, 10, "claude")],
}


@pytest.fixture(scope="module")
def scanned(spark):
    found = snapshots.processes(spark.createDataFrame([r for rows in SCANS.values() for r in rows], RAW), rules.default_pack())
    return found, spark.createDataFrame([("web", at * SECOND) for at in SCANS], "host string, at long")


def known(df):
    return sorted((r.host, int(r.ts.timestamp() * 1e6), r.kind, r.pid, r.user, r.ses, sorted(r.fields.items())) for r in df.collect())


def test_what_is_worth_an_event(scanned):
    got = {(r.at // SECOND, r.pid): r.fields for r in scanned[0].filter("at = 0 OR at = 61000000").collect()}
    assert set(got) == {(0, 10), (0, 12), (61, 10), (61, 14)}
    assert (got[0, 10]["agent"], got[0, 10]["flags"], got[0, 10]["tty"]) == ("claude-code", "--dangerously-skip-permissions", "pts/1")
    assert got[0, 12]["env.AI_AGENT"] == "helper" and "env.HOME" not in got[0, 12] and got[61, 14]["comm"] == "xred"


def test_scans_become_events(scanned):
    got = [(at // SECOND, kind, pid) for _, at, kind, pid, *_ in known(snapshots.process_events(*scanned))]
    assert got == [(0, "proc.seen", 10), (0, "proc.seen", 12), (30, "proc.gone", 12), (30, "proc.seen", 12), (61, "proc.gone", 12), (61, "proc.seen", 10), (61, "proc.seen", 14), (70, "proc.gone", 10), (70, "proc.gone", 14), (80, "proc.seen", 10)]
    invalid = [f for _, at, kind, pid, _, _, f in known(snapshots.process_events(*scanned)) if (at, kind, pid) == (30 * SECOND, "proc.seen", 12)]
    assert dict(invalid[0])["env.AI_AGENT"] == "invalid-declaration"
    empty = snapshots.process_events(scanned[0].limit(0), scanned[1].limit(0))
    assert empty.columns == snapshots.EVENT and empty.collect() == []


def test_streams_give_the_same(spark, scanned, tmp_path):
    rnd = random.Random(6)
    rows = [(f"h{h}", (1000 + 10 * k + h) * SECOND, pid, rnd.choice([1, 1, 1, 2]), 5, "ann", {"comm": f"c{pid}", "uid": "7", "cmd": str(k)}) for h in range(3) for k in range(20) for pid in range(1, 6) if rnd.random() < 0.7 and k != 7]
    kind = scanned[0].schema
    frame = spark.createDataFrame(rows, "host string, at long, pid int, start_ticks long, ses int, user string, fields map<string,string>")
    marks = spark.createDataFrame([(f"h{h}", (1000 + 10 * k + h) * SECOND) for h in range(3) for k in range(20)], "host string, at long")
    end = spark.createDataFrame([("end", 10_000 * SECOND)], "host string, at long")
    nothing = lambda df: df.select("host", "at", *[F.lit(None).cast(kind[c].dataType).alias(c) for c in snapshots.PROCESS[2:]])
    every = frame.select(*[F.col(c).cast(kind[c].dataType).alias(c) for c in snapshots.PROCESS]).unionByName(nothing(marks))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    audit.with_states(spark)
    try:
        for part in [*[every.filter((F.col("at") + F.xxhash64("host", "pid") % 3 * SECOND).between(low, low + 50 * SECOND - 1)) for low in range(950 * SECOND, 1250 * SECOND, 50 * SECOND)], nothing(end)]:
            part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
            live.run_once(scans.process_events_stream(spark.readStream.schema(every.schema).parquet(str(tmp_path / "in")), refresh=35 * SECOND), str(tmp_path / "out"), str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got, want = known(spark.read.parquet(str(tmp_path / "out"))), known(snapshots.process_events(frame, marks, refresh=35 * SECOND))
    assert got == want and {k for _, _, k, *_ in got} == {"proc.seen", "proc.gone"}


def test_sockets_become_events(spark):
    calls = spark.createDataFrame(
        [("web", at * SECOND, i, "1.2.3.4", port, "established", uid, name) for at, i, port, uid, name in [(0, 5, 443, 1000, "api.openai.com"), (30, 5, 443, 1000, "api.openai.com"), (30, 6, 443, 7, "api.openai.com"), (61, 6, 443, 7, "api.openai.com"), (80, 5, 443, 1000, "api.openai.com"), (0, 8, 443, 1, "example.org"), (0, 9, 22, 1, "api.openai.com")]],
        "host string, at long, inode long, dst string, dst_port int, state string, uid int, name string",
    )
    marks = spark.createDataFrame([("web", at * SECOND) for at in (0, 30, 61, 80)], "host string, at long")
    owners = spark.createDataFrame([("web", 0, 5, 70), ("web", 0, 5, 60), ("web", 80 * SECOND, 5, 71)], "host string, at long, inode long, pid int")
    people = spark.createDataFrame([("web", 0, 60, 3, "node", 1000, 1000, "ann")], "host string, at long, pid int, ses int, comm string, uid int, loginuid int, user string")
    got = [(at // SECOND, pid, user, ses, dict(f).get("comm"), dict(f)["uid"], dict(f)["agent"]) for _, at, _, pid, user, ses, f in known(snapshots.socket_events(snapshots.service_calls(calls, rules.default_pack()), marks, owners, people))]
    assert got == [(0, 60, "ann", 3, "node", "1000", "codex-cli"), (30, 0, "", 0, None, "7", "codex-cli"), (80, 71, "", 0, None, "1000", "codex-cli")]
