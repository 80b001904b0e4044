"""Sessions and alerts of a stream, from shuffled batches and over restarts, against the batch's."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import correlate, policy, running
from tallyhound.sources import rules
from tallyhound.sources.tables import stored
from tallyhound.streaming import audit, live, sessions
from tests.test_sources import SCENES, event, login

COLUMNS = "seq long, host string, t double, kind string, source string, user string, src_ip string, src_port int, pid int, ses int, fields map<string,string>"
BUSY = [
    event(0, "ssh.banner", pid=50, banner="SSH-2.0-paramiko_3"), login(1, "ops", "10.0.0.3", 900, 50, fp="K"), event(1.5, "audit.login", "ops", "10.0.0.3", pid=50, ses=5, res="success"),
    *[event(10 + 2 * k, "audit.execve", pid=100 + k, ses=5, ppid=51, cmd="cd /srv && git --no-pager log 2>&1 | head -n 20", argv0="git") for k in range(12)], *[event(600.0 * k, "audit.execve", pid=200 + k, ses=5, ppid=51, cmd="ls", argv0="ls") for k in range(1, 7)],
]
DAY = 86_400.0


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """(contents of the batch, those of the stream, alerts of the stream): six rounds, each with queries started anew."""
    root = tmp_path_factory.mktemp("live")
    scenes = SCENES | {"busy": BUSY}
    rows = [(host, float(r[0]), *r[1:]) for host, scene in scenes.items() for r in scene]
    rows = [(k, *r) for k, r in enumerate(rows)]
    ends = [(10_000 + k, "end", DAY * (k + 1), *login(DAY * (k + 1), f"z{k}", "10.0.0.9", 990 + k, 70 + k, fp="Z")[1:]) for k in range(4)]  # they move the watermark on
    rnd = random.Random(8)
    cuts = [2.2, 9.0, 120.0, 901.5, 1e9]
    batches = [[] for _ in cuts]
    for r in rows:
        at = r[2] + rnd.choice([0, 0, 0, 12.0])  # some come twelve seconds late
        batches[next(k for k, cut in enumerate(cuts) if at < cut)].append(r)
    frame = lambda part: spark.createDataFrame(part, COLUMNS).withColumn("ts", F.timestamp_seconds(F.lit(1789000000) + F.col("t"))).drop("t")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    audit.with_states(spark)
    try:
        for part in [*batches, *[[e] for e in ends]]:
            rnd.shuffle(part)
            frame(part).repartition(2).write.mode("append").parquet(str(root / "in"))
            stream = spark.readStream.schema(frame(part).schema).parquet(str(root / "in"))
            live.run_once(sessions.contents_stream(stream), str(root / "contents"), str(root / "c1"))
        found = spark.read.parquet(str(root / "contents"))
        stored_rows = spark.readStream.schema(found.schema).parquet(str(root / "contents"))
        live.run_once(sessions.alerts_stream(stored_rows, rules.default_pack()), str(root / "alerts"), str(root / "c2"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = stored(correlate.contents(stored(frame(rows), "scene-events"))[0], "batch-contents")
    return batch, found.filter("host <> 'end'"), spark.read.parquet(str(root / "alerts")).filter("host <> 'end'")


def test_contents_are_those_of_the_batch(streamed):
    batch, stream, _ = streamed
    known = lambda df: {(r.host, r.seq): (r.user, r.fp, r.src_ip, r.session_start, r.us, r.kind, r.pid, sorted(r.fields.items()), r.attributed, r.opened, r.cmd, r.origin, r.argv0) for r in df.collect()}
    got, want = known(stream), known(batch)
    assert got == want and len(got) > 200 and stream.count() == len(got)


def test_alerts_are_those_of_the_batch(spark, streamed):
    batch, _, alerts = streamed
    v = running.verdicts(batch, rules.default_pack()).withColumns({"freeze": F.lit(""), "until": F.lit(None).cast("long")})
    want = policy.alerts(v, key=correlate.SESSION, ended=correlate.WINDOW, now=1 << 60)
    known = lambda df: sorted((r.host, r.user, r.session_start, r.us, r.event, r["rank"]) for r in df.collect())
    got = known(alerts)
    assert got == known(want)
    assert {e for *_, e, _ in got} >= {"info", "agent_declared", "agent_detected", "agent_still_active", "agent_ended"}


def test_a_late_log_in_takes_what_its_connection_did_before():
    host = sessions.Host("h", {m: {} for m in sessions.MAPS})
    at = lambda k, kind, user="", port=900, pid=50, **f: {"seq": k, "us": k * 1_000_000, "kind": kind, "user": user, "src_ip": "10.0.0.3" if port else "", "src_port": port, "pid": pid, "ses": 0, "fields": f}
    host.apply(at(1, "ssh.banner", port=0, banner="x"))
    host.apply(at(2, "ssh.session_start", stype="command"))
    host.apply(at(3, "ssh.session_start", "ann", stype="shell"))
    assert host.out == []
    host.apply(at(4, "ssh.auth_ok", "ann", fp="K"))
    assert [(r[1:5], r[6]) for r in host.out] == [(("ann", "K", "10.0.0.3", 1_000_000), k) for k in (1, 2, 3, 4)]
    # without a log-in the user it names counts once it has waited, or closes
    host.apply(at(20, "ssh.session_start", "bob", 901, 60, stype="shell"))
    host.trim(30 * 1_000_000)
    assert len(host.out) == 4
    host.trim(20 * 1_000_000 + sessions.PATIENCE)
    assert host.out[-1][1:4] == ("bob", "-", "10.0.0.3")
    host.apply(at(100, "ssh.disconnect", "bob", 901, 60, scope="connection"))
    host.trim(100 * 1_000_000 + correlate.WINDOW + 1)
    assert set(host.m["conns"]) == {"h|10.0.0.3|900@2000000"} and not any(k.startswith("h|bob") for k in host.m["sessions"])


def test_freeze_spans_give_the_first_window_listed():
    freezes = [("a", 10, 20), ("b", 5, 30), ("none", 7, 7), ("c", 28, 40), ("d", 12, 14)]
    starts, spans = live.freeze_spans(freezes)
    for t in range(45):
        assert spans[int(starts.searchsorted(t, side="right"))] == next(((n, end) for n, start, end in freezes if start <= t < end), ("", None))
    assert live.freeze_spans([])[1] == [("", None)]


def test_keys_share_groups_and_end_each_at_its_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "GROUPS", 1)
    minute, at = 60_000_000, "k string, ts timestamp, us long, rank int, declared boolean"
    batches = [[("a", 0, 2), ("b", 1, 2), (None, 1, 0)], [("b", 10, 3), ("c", 20, 1)], [("c", 60, 2), ("a", 61, 1)], [("x", 200, 0)], [("x", 400, 0)]]
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([(k, t * minute, r) for k, t, r in batch], "k string, us long, rank int")
        rows.select("k", F.timestamp_micros("us").alias("ts"), "us", "rank", F.lit(False).alias("declared")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(at).parquet(str(tmp_path / "in"))
        live.run_once(live.policy_stream(stream, key="k"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted((r.k, r.us // minute, r.event, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # a row at the very first moment is not after the watermark, as with a group for each key
    assert got == [("a", 61, "info", 1), ("b", 1, "agent_detected", 2), ("b", 10, "agent_ended", 3), ("b", 10, "agent_high", 3), ("c", 20, "info", 1), ("c", 60, "agent_detected", 2), ("c", 60, "agent_ended", 2)]
