"""Events of a stream put into sessions, host by host, and judged at each event: what correlate and run do in a batch.

Each host's events wait until the watermark has passed them, so that they are applied in the order of their times however
the batches cut and shuffle them. A host keeps maps: connections, by process and by address and port; processes, numbers
of users and audit sessions, and whose they are; each user's latest session. A connection whose log-in has not been seen
is provisional: what belongs to it is held, and gets the session of the log-in once that comes, or that of the user it
names when it closes or has waited long enough. Timers let go of what is old.

Differences to a batch: a command of a user whose connection is still provisional cannot wait for it and goes to the
user's session before, if any; what a provisional connection brings late does not move a session's start.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhound.functions.text import SHELL_COMMAND
from tallyhound.operators import correlate, running, score
from tallyhound.operators.policy import CADENCE, Told
from tallyhound.sources.rules import Pack

_PLUMBING = [re.compile(p) for p in correlate.PLUMBING]
_SHELL = re.compile(SHELL_COMMAND)
_NAME = re.compile(r"[A-Za-z0-9._@:+-]{1,64}")
#: How long a provisional connection waits for its log-in, and what is known of processes and audit sessions is kept, in microseconds.
PATIENCE, KEEP = 60 * 1_000_000, 24 * 3600 * 1_000_000
MAPS = ["conns", "pids", "pairs", "children", "owners", "places", "uids", "ses", "procs", "commands", "forks", "latest", "sessions"]
ROW = "host string, user string, fp string, src_ip string, session_start long, us long, seq long, kind string, pid int, fields string, attributed boolean, conn string, opened long, cmd string, origin string, argv0 string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
TAKEN = ["seq", "us", "kind", "user", "src_ip", "src_port", "pid", "ses", "fields"]


def integer(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        return 0


class Host:
    """One host's events, in order, into rows as correlate.contents() has them. maps holds a mapping for each of MAPS."""

    def __init__(self, host: str, maps: dict[str, MutableMapping], gap: int = correlate.WINDOW):
        self.host, self.gap, self.m = host, gap, maps
        self.out: list[tuple] = []

    # -- connections

    def _conn(self, pair: str | None, pid: int, us: int) -> str:
        """The open connection of a pair or, without one, of a process; a new one where there is none."""
        held = self.m["pids"].get(str(pid)) if pid > 0 else None
        if pair is None:
            if held is None:
                held = f"{pid}@{us}"
                self.m["conns"][held] = {"pair": None, "user": "", "any": "", "fp": "-", "ip": "", "pid": 0, "child": 0, "opened": us, "closed": None, "logged": False, "live": False, "waiting": []}
                self.m["pids"][str(pid)] = held
            return held
        own = self.m["pairs"].get(pair)
        if own is None:
            own = f"{self.host}|{pair}@{us}"
            self.m["conns"][own] = {"pair": pair, "user": "", "any": "", "fp": "-", "ip": "", "pid": 0, "child": 0, "opened": us, "closed": None, "logged": False, "live": False, "waiting": []}
            self.m["pairs"][pair] = own
        if held is not None and held != own and (first := self.m["conns"].get(held)) and first["pair"] is None:  # what the process did before its address was known
            conn = self.m["conns"][own]
            conn["waiting"] = sorted([r | {"conn": own} for r in first["waiting"]] + conn["waiting"], key=lambda r: (r["us"], r["seq"]))
            conn["opened"] = min(conn["opened"], first["opened"])
            conn["live"] = conn["live"] or first["live"]
            conn["child"] = conn["child"] or first["child"]
            self.m["conns"][own] = conn
            del self.m["conns"][held]
        if pid > 0:
            self.m["pids"][str(pid)] = own
        return own

    def _key(self, conn: dict) -> list[str]:
        return [self.host, conn["user"] or conn["any"], conn["fp"], conn["ip"]]

    def _settle(self, name: str, conn: dict, force: bool = False) -> None:
        """Gives what a connection holds its session, if that is known by now (or must do)."""
        if not (conn["logged"] or force) or not (conn["user"] or conn["any"]) or not conn["live"] or conn["pair"] is None:
            return
        conn["logged"] = True
        waiting, conn["waiting"] = conn["waiting"], []
        self.m["conns"][name] = conn
        for row in waiting:
            if "of" in row and row.pop("of") != (conn["user"] or conn["any"]):
                continue  # a hook's word for another user
            self._emit(row, self._key(conn), True, known=True)

    def _ssh(self, e: dict) -> None:
        f = e["fields"]
        if f.get("note") == "user_child" and integer(f.get("child_pid", "")) > 0:
            self.m["children"][str(integer(f["child_pid"]))] = e["pid"]
        pid = self.m["children"].get(str(e["pid"]), e["pid"]) if e["pid"] > 0 else 0
        pair = f"{e['src_ip']}|{e['src_port']}" if e["src_ip"] and e["src_port"] > 0 else None
        closes = e["kind"] == "ssh.disconnect" and f.get("scope", "") != "channel"
        if pair is None and pid <= 0 or closes and pair is None and str(pid) not in self.m["pids"]:
            return
        name = self._conn(pair, pid, e["us"])
        conn = self.m["conns"][name]
        if e["user"]:
            conn["any"] = e["user"]
        conn["ip"] = e["src_ip"] or conn["ip"]
        conn["pid"] = max(conn["pid"], pid)
        conn["live"] = conn["live"] or not closes
        if e["kind"] == "ssh.auth_ok":
            conn["user"], conn["fp"], conn["pid"] = e["user"] or conn["user"], f.get("fp") or conn["fp"], pid or conn["pid"]
            conn["logged"] = conn["logged"] or bool(e["user"])
        if f.get("note") == "user_child":
            conn["child"] = max(conn["child"], integer(f.get("child_pid", "")))
        conn["waiting"].append(e | {"conn": name})
        if closes:
            conn["closed"] = e["us"]
            self.m["pids"].pop(str(pid), None)
            if conn["pair"]:
                self.m["pairs"].pop(conn["pair"], None)
        self.m["conns"][name] = conn
        for number in {conn["pid"], conn["child"]} - {0}:
            self.m["owners"][str(number)] = name
        if conn["user"] or conn["any"]:
            self.m["places"][f"{conn['user'] or conn['any']}|{conn['ip']}"] = name
        self._settle(name, conn, force=closes)

    def _hook(self, e: dict) -> None:
        """What a hook on the host declares: for an open connection of its user, and not in another user's name."""
        f, name = e["fields"], self.m["pairs"].get(f"{e['src_ip']}|{e['src_port']}")
        sender = self.m["uids"].get(f["uid"]) if f.get("uid") else None
        if f.get("name") != "AI_AGENT" or name is None or not _NAME.fullmatch(f.get("value", "")) or sender not in (None, e["user"]):
            return
        conn = self.m["conns"][name]
        conn["waiting"].append(e | {"conn": name, "of": e["user"]})
        self._settle(name, conn)
        if not conn["logged"]:
            self.m["conns"][name] = conn

    def _open(self, name: str | None, us: int) -> dict | None:
        conn = self.m["conns"].get(name) if name else None
        return conn if conn and (conn["closed"] is None or conn["closed"] >= us) else None

    # -- what happens on the host

    def _login(self, e: dict) -> None:
        f = e["fields"]
        user, ip = e["user"] or f.get("acct", ""), e["src_ip"] or f.get("addr", "")
        if f.get("res", "") not in ("", "success") or user in ("", "(unknown user)", "?"):
            return
        name = next((n for n in (self.m["owners"].get(str(e["pid"])) if e["pid"] > 0 else None, self.m["places"].get(f"{user}|{ip}")) if self._open(n, e["us"])), None)
        to = {"conn": name} if name else {"key": [self.host, user, "-", ip or "local"]}
        if e["ses"] > 0:
            self.m["ses"][str(e["ses"])] = to | {"us": e["us"]}
        self._place(e, to, True)

    def _local(self, e: dict) -> None:
        f = e["fields"]
        e["user"] = e["user"] or (self.m["uids"].get(f["uid"], "") if f.get("uid") else "")
        ppid = integer(f.get("ppid", ""))
        to = self.m["ses"].get(str(e["ses"])) if e["ses"] > 0 else None
        if to is None and e["kind"] != "audit.execve":
            if ppid > 1 and self._open(name := self.m["owners"].get(str(ppid)), e["us"]):
                to = {"conn": name}
            else:
                via = e["pid"] if e["kind"] in ("net.conn", "proc.gone") else ppid
                to = self.m["procs"].get(str(via)) if via > 1 else None
        if to is not None:
            if e["kind"] == "proc.seen" and e["pid"] > 0:
                self.m["procs"][str(e["pid"])] = to | {"us": e["us"]}
            self._place(e, to, True)
        elif e["user"]:
            last = self.m["latest"].get(e["user"])
            if last is not None:
                self._emit(e, last["key"], False)
            elif e["kind"] in ("proc.seen", "net.conn"):
                self._emit(e, [self.host, e["user"], "-", "local"], True)

    def _place(self, e: dict, to: dict, attributed: bool) -> None:
        name = to.get("conn")
        if name is None:
            self._emit(e, to["key"], attributed, known=True)
            return
        conn = self.m["conns"].get(name)
        if conn is None:
            return
        if conn["logged"]:
            self._emit(e, self._key(conn), attributed, known=True)
        else:
            conn["waiting"].append(e | {"conn": None})
            self.m["conns"][name] = conn

    def _emit(self, e: dict, key: list[str], attributed: bool, known: bool = False) -> None:
        if known:
            self.m["latest"][key[1]] = {"key": key, "us": e["us"]}
        name = "|".join(key)
        start, last = self.m["sessions"].get(name, (None, None))
        if start is None or e["us"] - last > self.gap:
            start, last = e["us"], e["us"]
        self.m["sessions"][name] = (start, max(last, e["us"]))
        f, kind, shown = e["fields"], e["kind"], (None, None, None)
        cmd = f.get("cmd", "")
        if kind == "audit.execve":
            ppid = integer(f.get("ppid", ""))
            hidden = any(p.search(cmd) for p in _PLUMBING) or ppid > 1 and ppid != e["pid"] and self.m["commands"].get(str(ppid), (False, 0))[0]
            if e["pid"] > 0:
                self.m["commands"][str(e["pid"])] = (hidden, e["us"])
            if ppid > 1 and any(p.search(cmd) for p in _PLUMBING[:2]):
                self.m["forks"][str(ppid)] = e["us"]
            if hidden:
                kind = "plumbing"
            else:
                whole = _SHELL.match(cmd) if ppid > 1 and str(ppid) in self.m["forks"] else None
                shown = (whole[1] if whole else cmd, "auditd", f.get("argv0", ""))
        elif kind == "ssh.session_start" and f.get("stype") in ("command", "forced-command"):
            shown = (cmd, "sshlog", "")
            if e["pid"] > 1:
                self.m["forks"][str(e["pid"])] = e["us"]
        conn = self.m["conns"].get(e["conn"]) if e.get("conn") else None
        self.out.append((*key, start, e["us"], e["seq"], kind, e["pid"], json.dumps(f), attributed, e.get("conn"), conn["opened"] if conn else None, *shown))

    def apply(self, e: dict) -> None:
        f = e["fields"]
        if e["kind"] in ("ssh.pam_open", "proc.seen") and f.get("uid") and e["user"]:
            self.m["uids"][f["uid"]] = e["user"]
        if e["kind"] == "ssh.env" and f.get("via") == "sshrc":
            self._hook(e)
        elif e["kind"].startswith("ssh.") and e["kind"] != "ssh.auth_fail":
            self._ssh(e)
        elif e["kind"] == "audit.login":
            self._login(e)
        elif e["kind"] in ("audit.execve", "proc.seen", "proc.gone", "net.conn", "audit.logout"):
            self._local(e)

    def trim(self, now: int) -> None:
        """Settles provisional connections that have waited, and lets go of what is over."""
        gone = []
        for name, conn in list(self.m["conns"].items()):
            if conn["waiting"] and now - conn["waiting"][0]["us"] >= PATIENCE:
                self._settle(name, conn, force=True)
            if now - (conn["closed"] if conn["closed"] is not None else now) > self.gap or not (conn["user"] or conn["any"]) and now - conn["opened"] > KEEP:
                gone.append(name)
        for name in gone:
            del self.m["conns"][name]
        for index in ("owners", "places", "pids", "pairs"):
            for k, name in list(self.m[index].items()):
                if name in gone:
                    del self.m[index][k]
        for which, at in (("ses", lambda v: v["us"]), ("procs", lambda v: v["us"]), ("latest", lambda v: v["us"]), ("commands", lambda v: v[1]), ("forks", lambda v: v), ("sessions", lambda v: v[1])):
            limit = self.gap if which == "sessions" else KEEP
            for k, v in list(self.m[which].items()):
                if now - at(v) > limit:
                    del self.m[which][k]


class Held(MutableMapping):
    """A map state as a mapping; values are JSON. What was read or written in a batch is kept until it is written back."""

    def __init__(self, state) -> None:  # noqa: ANN001
        self.state, self.now, self.changed = state, {}, set()

    def __getitem__(self, k: str):  # noqa: ANN204
        if k not in self.now:
            self.now[k] = json.loads(self.state.getValue((k,))[0]) if self.state.containsKey((k,)) else None
        if self.now[k] is None:
            raise KeyError(k)
        return self.now[k]

    def __setitem__(self, k: str, v) -> None:  # noqa: ANN001
        self.now[k] = v
        self.changed.add(k)

    def __delitem__(self, k: str) -> None:
        self[k] = None

    def __iter__(self) -> Iterator[str]:
        stored = [k for (k,) in self.state.keys()]  # noqa: SIM118
        return iter([k for k in dict.fromkeys([*stored, *self.now]) if self.get(k) is not None])

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def write(self) -> None:
        for k in self.changed:
            if self.now[k] is None:
                if self.state.containsKey((k,)):
                    self.state.removeKey((k,))
            else:
                self.state.updateValue((k,), (json.dumps(self.now[k]),))
        self.now, self.changed = {}, set()


class Correlation(StatefulProcessor):
    """Rows of contents() of one host's events, as the watermark passes them."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second long", "events string")
        self.maps = {m: Held(handle.getMapState(m, "k string", "v string")) for m in MAPS}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        met: dict[int, list] = {}
        for frame in rows:
            for values in zip(*[frame[c] for c in TAKEN]):
                e = dict(zip(TAKEN, values))
                e |= {c: int(e[c]) for c in ("seq", "us", "src_port", "pid", "ses")} | {"fields": json.loads(e["fields"])}
                met.setdefault(e["us"] // 1_000_000, []).append(e)
        for second, events in met.items():
            held = json.loads(self.waiting.getValue((second,))[0]) if self.waiting.containsKey((second,)) else []
            self.waiting.updateValue((second,), (json.dumps(held + events),))
            self.handle.registerTimer((second + 1) * 1000)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000
        host = Host(key[0], self.maps, self.gap)
        for second in sorted(int(k[0]) for k in self.waiting.keys() if int(k[0]) < until):  # noqa: SIM118
            for e in sorted(json.loads(self.waiting.getValue((second,))[0]), key=lambda e: (e["us"], e["seq"])):
                host.apply(e)
            self.waiting.removeKey((second,))
        host.trim(until * 1_000_000)
        if any(c["waiting"] for c in self.maps["conns"].values()):
            self.handle.registerTimer((until + PATIENCE // 1_000_000) * 1000)
        for m in self.maps.values():
            m.write()
        yield pd.DataFrame(host.out, columns=COLUMNS)

    def close(self) -> None:
        pass


def contents_stream(events: DataFrame, *, gap: int = correlate.WINDOW, late: str = "30 seconds") -> DataFrame:
    """correlate.contents() of a stream of events (ts, seq, host, kind, user, src_ip, src_port, pid, ses, fields).

    Rows over `late` behind the newest are dropped by the watermark. One host's events meet in one task, which holds its
    state in the RocksDB state store (streaming.audit.with_states()).
    """
    e = correlate.prepared(events).withColumn("fields", F.to_json("fields")).select("host", "ts", *TAKEN)
    placed = e.withWatermark("ts", late).groupBy("host").transformWithStateInPandas(Correlation(gap), ROW, "Append", "EventTime")
    return placed.withColumn("fields", F.from_json("fields", "map<string,string>"))


ALERTS = "host string, user string, fp string, src_ip string, session_start long, us long, seq long, event string, rank int, score int"
ALERT_COLUMNS = [c.split()[0] for c in ALERTS.split(", ")]


class Judgement(StatefulProcessor):
    """Alerts of one session from what its rows say by themselves (running.facts())."""

    def __init__(self, rules: running.Rules, cadence: int, gap: int, freezes: list[tuple[str, int, int]]):
        self.rules, self.cadence, self.gap, self.freezes = rules, cadence, gap, freezes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "session binary, us long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        session, told, at = running.Session(self.rules), Told(self.cadence), (0, 0)
        if self.state.exists():
            held, *at = self.state.get()
            session, told = pickle.loads(held)  # noqa: S301  written by this class only
            session.rules = self.rules
        out = []
        every = pd.concat(list(rows)).sort_values(["us", "seq"])
        for c in ("conn", "banner", "said", "marked"):
            every[c] = every[c].astype(object).where(every[c].notna(), None)
        for r in every.itertuples(index=False):
            session.add(r)
            total, rank, declared, _ = session.verdict(int(r.us), r.who)
            freeze, until = next(((name, end) for name, start, end in self.freezes if start <= r.us < end), ("", None))
            if said := told.step(int(r.us), rank, declared, freeze, until):
                out.append((*key, int(r.us), int(r.seq), *said, total))
            at = max(tuple(at), (int(r.us), int(r.seq)))
        session.rules = None
        self.state.update((pickle.dumps((session, told)), *at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((at[0] + self.gap) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=ALERT_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        if self.state.exists():
            held, us, seq = self.state.get()
            _, told = pickle.loads(held)  # noqa: S301
            if told.top >= 2:
                out.append((*key, us, seq, "agent_ended", told.top, 0))
            self.state.clear()
        yield pd.DataFrame(out, columns=ALERT_COLUMNS)

    def close(self) -> None:
        pass


def alerts_stream(
    contents: DataFrame, pack: Pack, *, thresholds: tuple[int, int, int] = (score.INFO, score.ALERT, score.HIGH), cadence: int = CADENCE, gap: int = correlate.WINDOW, freezes: list[tuple[str, int, int]] = (), late: str = "90 seconds"
) -> DataFrame:
    """(session, us, seq, event, rank, score) of a stream of contents: each session's alerts as they come, and its end.

    `late` must be above what provisional connections wait. freezes (name, start, end), in microseconds, go to every task.
    """
    facts = running.facts(contents, pack).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    judge = Judgement(running.Rules.of(pack, thresholds), cadence, gap, list(freezes))
    return facts.groupBy(*correlate.SESSION).transformWithStateInPandas(judge, ALERTS, "Append", "EventTime")
