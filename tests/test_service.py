"""Logs that arrive in rounds become alerts, over services that are started anew each time."""

import time

from pyspark.sql import functions as F

from tallyhound import run
from tallyhound.config import Config, Freeze
from tallyhound.operators import correlate, policy, running
from tallyhound.sources import rules
from tallyhound.sources.tables import stored
from tallyhound.streaming import counters
from tallyhound.streaming.service import Service, events_read

DECLARED = 'ai-agent-declare: AI_AGENT=claude_code@2 user=bob from=10.0.0.4 port=901'


def server(second, text):
    return f"2026-09-14T10:{second // 60:02}:{second % 60:02}+00:00 web {text}"


def command(serial, second, cmd):
    head = f"msg=audit({1789380000 + second}.000:{serial}):"
    return [f'type=SYSCALL {head} arch=c000003e syscall=59 success=yes ppid=51 pid={700 + serial} auid=1000 uid=1000 ses=5 comm="x" exe="/bin/x"\x1dAUID="ann"', f'type=EXECVE {head} argc=1 a0="{cmd}"', f"type=EOE {head}"]


ROUNDS = [
    ([server(0, "sshd[50]: debug1: Remote protocol version 2.0, remote software version paramiko_3.1"), server(1, "sshd[50]: Accepted publickey for ann from 10.0.0.3 port 900 ssh2: ED25519 SHA256:abc"), server(2, "sshd[60]: Accepted publickey for bob from 10.0.0.4 port 901 ssh2: ED25519 SHA256:def")], command(1, 5, "cat x | head -n 5")),
    ([server(20, DECLARED)], [x for k in range(12) for x in command(10 + k, 10 + 2 * k, "git --no-pager log 2>&1 | head -n 20")]),
    ([server(60 * 50, "sshd[70]: Accepted publickey for zoe from 10.0.0.5 port 902 ssh2: ED25519 SHA256:z")], command(500, 60 * 50, "ls")),
    ([server(60 * 59, "sshd[71]: Accepted publickey for zoe from 10.0.0.5 port 903 ssh2: ED25519 SHA256:z")], command(900, 60 * 59, "ls")),
]


def test_rounds_of_logs_become_alerts(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    config = Config(freeze=[Freeze("early", "0 10 * * *", "15s")])
    span, told, counted = (1789380000_000_000, 1789383600_000_000), [], counters.Counters("7")
    spark.streams.addListener(counted)
    (tmp_path / "auth").mkdir()
    (tmp_path / "audit").mkdir()
    try:
        for k, (auth, audit) in enumerate(ROUNDS):
            (tmp_path / "auth" / f"{k}.log").write_text("\n".join(auth) + "\n")
            (tmp_path / "audit" / f"{k}.log").write_text("\n".join(audit) + "\n")
            deliver = lambda batch, number: told.extend(batch.collect())
            Service(spark, str(tmp_path / "state"), [str(tmp_path / "auth")], [(str(tmp_path / "audit"), "web")], config, deliver=deliver, span=span, late="5 seconds").start(once=True)
        for _ in range(100):  # the listener hears of it a little later
            if sum(counted.series().get("tallyhound_alerts_total", {}).values()) >= len(told):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counted)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted((r.user, r.us, r.event, r["rank"]) for r in told)
    contents = stored(correlate.contents(stored(events_read(spark, str(tmp_path / "state")), "events"))[0], "contents")
    v = run.frozen(stored(running.verdicts(contents, rules.default_pack()), "verdicts"), config)
    want = sorted((r.user, r.us, r.event, r["rank"]) for r in policy.alerts(v, key=correlate.SESSION, ended=correlate.WINDOW, now=1 << 60).filter(F.col("user") != "zoe").collect())
    assert [x for x in got if x[0] != "zoe"] == want
    assert {(u, e) for u, _, e, _ in want} >= {("ann", "agent_ended"), ("ann", "freeze_violation"), ("bob", "agent_declared")}
    series = counted.series({"hook": {"sent": 3, "lost": 1}}, counters.open_sessions(contents, correlate.WINDOW))
    kinds = {k: n for ((_, k),), n in series["tallyhound_events_total"].items()}
    assert kinds == {r.kind: r["count"] for r in events_read(spark, str(tmp_path / "state")).groupBy("kind").count().collect()}
    assert sum(series["tallyhound_alerts_total"].values()) == len(told) and series["tallyhound_alerts_total"][("level", "info"), ("class", "declared_agent")] == 1
    assert series["tallyhound_sessions_open"] == {(): 2.0} and series["tallyhound_last_event_timestamp_seconds"][("source", "auditd"),] == 1789380000 + 60 * 59
    assert set(series) == {"tallyhound_" + k for k in counters.HELP}
    text = counted.exposition(delivered={"hook": {"sent": 3}})
    assert 'tallyhound_sink_sent_total{sink="hook"} 3' in text and 'tallyhound_build_info{version="7"} 1' in text and "# TYPE tallyhound_events_total counter" in text and 'tallyhound_reader_up{name="contents"} 0' in text
