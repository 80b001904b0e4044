"""Counters and gauges of a service from its own runs: Spark observes the rows that pass, a listener adds them up.

Nothing is read a second time for them. The series are those of sinks.exposition(): events by kind and when each source was
last heard, alerts by level and class, what receivers got, rows that came too late, readers that run, and sessions.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tallyhound.operators.score import LEVELS
from tallyhound.sources import sinks

KINDS = ["ssh.auth_ok", "ssh.auth_fail", "ssh.session_start", "ssh.banner", "ssh.env", "ssh.pam_open", "ssh.disconnect", "audit.login", "audit.logout", "audit.execve", "proc.seen", "proc.gone", "net.conn"]
EVENTS = ["info", "agent_detected", "agent_high", "agent_declared", "agent_still_active", "freeze_violation", "agent_ended"]
HELP = {
    "build_info": "The version; always 1.", "events_total": "Events of the readers, by kind.", "events_dropped_total": "Rows that came after the watermark.", "sessions_open": "Sessions that an event has prolonged within the window.",
    "alerts_total": "Alerts, by level and class.", "sink_sent_total": "Alerts delivered, by receiver.", "sink_failed_total": "Alerts given up after all attempts, by receiver.", "sink_dropped_total": "Alerts dropped unsent, by receiver; none are.",
    "reader_up": "1 while a reader runs.", "last_event_timestamp_seconds": "Time of the latest event, by source.",
}


def observed_events(events: DataFrame, name: str) -> DataFrame:
    """events (kind, source, ts), whose counts a listener gets under events:name."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    return events.observe(f"events:{name}", *counts, F.count("*").alias("all"), F.max("source").alias("source"), F.max(F.unix_micros("ts")).alias("last"))


def observed_alerts(alerts: DataFrame, name: str = "alerts") -> DataFrame:
    """alerts (event, rank) of a service, whose counts a listener gets under alerts:name. The class is declared_agent for what is told of a declaration, else suspected_agent from alert on."""
    said = F.when(F.col("event") == "agent_declared", "declared_agent").when(F.col("rank") >= 2, "suspected_agent").otherwise("human")
    return alerts.observe(f"alerts:{name}", *[F.count_if((F.col("rank") == r) & (said == c)).alias(f"{LEVELS[r]}|{c}") for r in range(1, 4) for c in ("declared_agent", "suspected_agent", "human")])


class Counters(StreamingQueryListener):
    """Adds up what the queries of this process observe; give it to spark.streams.addListener()."""

    def __init__(self, version: str = "1", prefix: str = "tallyhound_"):
        self.version, self.prefix, self.lock = version, prefix, threading.Lock()
        self.counts: dict[str, dict[tuple[tuple[str, str], ...], float]] = defaultdict(lambda: defaultdict(float))
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            self.names[str(event.id)] = event.name or str(event.id)
            self.counts["reader_up"][("name", self.names[str(event.id)]),] = 1.0

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            self.counts["reader_up"][("name", self.names.get(str(event.id), str(event.id))),] = 0.0

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
            self.counts["events_dropped_total"][()] += max(0, late)
            for name, row in event.progress.observedMetrics.items():
                self._row(name.split(":", 1)[0], row.asDict())

    def _row(self, what: str, row: dict) -> None:
        if what == "events":
            if row["last"] is not None:
                at = (("source", row["source"] or ""),)
                self.counts["last_event_timestamp_seconds"][at] = max(self.counts["last_event_timestamp_seconds"][at], row["last"] / 1e6)
            other = row["all"] - sum(row[k] for k in KINDS)
            for k, n in [*((k, row[k]) for k in KINDS), ("other", other)]:
                if n:
                    self.counts["events_total"][("kind", k),] += n
        elif what == "alerts":
            for k, n in row.items():
                if n:
                    level, said = k.split("|")
                    self.counts["alerts_total"][("level", level), ("class", said)] += n

    def series(self, delivered: dict[str, dict[str, int]] | None = None, sessions: int | None = None) -> dict[str, dict[tuple[tuple[str, str], ...], float]]:
        """All series so far. delivered: delivery.Ledgered.counts; sessions: open_sessions(), where it is known."""
        with self.lock:
            out = {name: dict(values) for name, values in self.counts.items()}
        out["build_info"] = {(("version", self.version),): 1.0}
        out.setdefault("events_dropped_total", {(): 0.0})
        for sink, states in (delivered or {}).items():
            at = (("sink", sink),)
            out.setdefault("sink_sent_total", {})[at] = float(states.get("sent", 0))
            out.setdefault("sink_failed_total", {})[at] = float(states.get("lost", 0))
            out.setdefault("sink_dropped_total", {})[at] = 0.0
        if sessions is not None:
            out["sessions_open"] = {(): float(sessions)}
        return {self.prefix + name: values for name, values in out.items()}

    def exposition(self, **more) -> str:  # noqa: ANN003
        return sinks.exposition(self.series(**more), {self.prefix + k: v for k, v in HELP.items()})


def open_sessions(contents: DataFrame, gap: int) -> int:
    """How many sessions of a service's contents an event has prolonged within `gap` before the latest event of all."""
    last = contents.groupBy("host", "user", "fp", "src_ip", "session_start").agg(F.max("us").alias("us"))
    now = last.agg(F.max("us")).first()[0]
    return 0 if now is None else last.filter(F.col("us") >= now - gap).count()
