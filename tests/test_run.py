"""Logs to alerts, through the command line's own functions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyhound import run
from tallyhound.config import Config, Freeze
from tallyhound.operators import correlate
from tallyhound.sources import records, rules, sinks
from tallyhound.sources.tables import stored

SERVER = """\
2026-09-14T10:00:00+00:00 web sshd[50]: Accepted publickey for ann from 10.0.0.3 port 900 ssh2: ED25519 SHA256:abc
2026-09-14T10:00:01+00:00 web sshd[60]: Accepted publickey for bob from 10.0.0.4 port 901 ssh2: ED25519 SHA256:def
2026-09-14T10:00:02+00:00 web ai-agent-declare: AI_AGENT=claude_code@2 user=bob from=10.0.0.4 port=901
"""
AUDIT = """\
type=SYSCALL msg=audit(1789380003.000:7): arch=c000003e syscall=59 success=yes exit=0 ppid=51 pid=70 auid=1000 uid=1000 tty=pts0 ses=5 comm="ls" exe="/usr/bin/ls"
type=EXECVE msg=audit(1789380003.000:7): argc=2 a0="ls" a1="-l"
"""


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "auth.log").write_text(SERVER)
    (folder / "audit.log").write_text(AUDIT)
    return run.read_events(spark, server=[str(folder / "auth.log")], audit=[str(folder / "audit.log")], host="web")


@pytest.fixture(scope="module")
def contents(events):
    return stored(correlate.contents(events)[0], "contents-of-logs")


def alerts(contents, **settings):
    return {r.user: r for r in run.told(contents, Config(**settings), rules.default_pack()).collect()}


def test_readers_meet_under_one_host(spark, events):
    assert {(r.host, r.kind) for r in events.collect()} == {("web", "ssh.auth_ok"), ("web", "ssh.env"), ("web", "audit.execve")}
    with pytest.raises(ValueError, match="host"):
        run.read_events(spark, audit=["x"])
    with pytest.raises(ValueError, match="nothing"):
        run.read_events(spark)


def test_a_declared_agent_is_told_and_a_human_is_not(contents):
    got = alerts(contents)
    assert set(got) == {"bob"}
    bob = got["bob"]
    assert (bob.event, bob.level, bob["class"], bob.agent, bob.key_fingerprint, bob.host) == ("agent_declared", "info", "declared_agent", "claude-code", "SHA256:def", "web")
    assert [(r.clue, r.category, r.evidence) for r in bob.reasons] == [("env.ai_agent", "identity", "AI_AGENT=claude_code@2")] and bob.freeze_window is None


def test_freezes_hold_and_may_exempt_what_is_declared(contents):
    always = {"name": "release", "cron": "0 * * * *", "duration": "1h"}
    bob = alerts(contents, freeze=[Freeze(**always)])["bob"]
    assert (bob.event, bob.level, bob.freeze_window.name, str(bob.freeze_window.until)) == ("freeze_violation", "high", "release", "2026-09-14 11:00:00")
    assert alerts(contents, freeze=[Freeze(**always, exempt_declared=True)])["bob"].event == "agent_declared"


def test_levels_empty_input_and_round_trip(spark, contents, tmp_path):
    assert alerts(contents, min_level="alert", freeze=[Freeze("night", "0 3 * * *", "1h")]) == {}
    assert alerts(contents.filter(F.lit(False))) == {}
    out = str(tmp_path / "alerts")
    sinks.append_json(out)(run.told(contents, Config(salt="s"), rules.default_pack()), 0)
    back = records.alerts(spark, out).collect()
    assert [(r.user, r.event, r.window.execs) for r in back] == [("u_" + hashlib.sha256(b"sbob").hexdigest()[:12], "agent_declared", 0)]
    assert [json.loads(r.value)["schema"] for r in spark.read.text(out).collect()] == [run.SCHEMA]


@pytest.fixture(scope="module")
def busy(spark):
    """An agent's session of an hour with a pause, then another user's log-in much later."""
    at = lambda t, kind, user="", ip="10.0.0.3", port=900, pid=50, ses=0, **f: (float(t), kind, "test", user, ip, port, pid, ses, {k: str(v) for k, v in f.items()})
    rows = [at(0, "ssh.auth_ok", "ops", fp="K"), at(0.5, "ssh.banner", banner="SSH-2.0-paramiko_3"), at(1, "audit.login", "ops", ses=5, res="success", port=0)]
    rows += [at(10 + 2 * k, "audit.execve", "", "", 0, 100 + k, 5, cmd="cd /srv && git --no-pager log 2>&1 | head -n 20", argv0="git", ppid=51) for k in range(12)]
    rows += [at(600 * k, "audit.execve", "", "", 0, 200 + k, 5, cmd="ls", argv0="ls", ppid=51) for k in range(1, 7)]
    rows += [at(9000, "ssh.auth_ok", "zoe", "10.0.0.9", 950, 70, fp="Z")]
    df = spark.createDataFrame(rows, "t double, kind string, source string, user string, src_ip string, src_port int, pid int, ses int, fields map<string,string>")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1789000000) + F.col("t"))).drop("t").withColumn("seq", F.monotonically_increasing_id())
    return stored(correlate.contents(stored(df, "busy-events"))[0], "busy-contents")


def test_a_session_crosses_levels_is_repeated_and_ends(busy):
    got = sorted((r.ts.timestamp() - 1789000000, r.event, r.level) for r in run.told(busy, Config(), rules.default_pack()).collect())
    events_ = [e for _, e, _ in got]
    assert events_[-1] == "agent_ended" and got[-1][0] == 3600 and events_.count("agent_still_active") == 1
    crossings = [level for _, e, level in got if e in ("info", "agent_detected", "agent_high")]
    assert crossings == sorted(crossings, key=["info", "alert", "high"].index) and len(crossings) >= 2 and len(set(crossings)) == len(crossings)
    assert next(t for t, e, _ in got if e == "agent_still_active") - max(t for t, e, _ in got if e in ("agent_detected", "agent_high")) >= 1800


def test_what_evidence_shows_of_commands(busy):
    for mode, want in (("argv0", "head -n 20 (12x)"), ("full", "cd /srv && git --no-pager log 2>&1 | head -n 20 (12x)"), ("none", "(12x)")):
        last = max(run.told(busy, Config(command_text=mode), rules.default_pack()).collect(), key=lambda r: r.ts)
        assert {r.evidence for r in last.reasons if r.clue == "style.pager_guard.head"} == {want}
