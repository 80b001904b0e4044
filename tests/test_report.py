"""The report on a fixture: spans, order, formats."""

import json
from datetime import datetime, timezone

import pytest

from tallyhound import report
from tallyhound.sources import records


def alert(session, minute, event, level, score, cls="suspected_agent", agent="", user="ann", clues=(), **more):
    return {"schema": "tallyhound.alert/1", "ts": f"2026-09-14T10:{minute:02}:00Z", "host": "web", "event": event, "class": cls, "mode": "remote_agent", "user": user, "src_ip": "10.0.0.3", "key_fingerprint": "K", "agent": agent, "score": score, "level": level,
            "reasons": [{"clue": c, "category": "style", "weight": w} for c, w in clues], "session_id": session, "connections": 1} | more


ALERTS = [
    alert("b", 1, "info", "info", 45, "human", clues=[("style.head", 5), ("pty.interactive", -15)]), alert("b", 9, "agent_detected", "alert", 75, agent="?id", clues=[("rhythm.burst", 20), ("style.head", 5)]),
    alert("a", 2, "agent_detected", "alert", 75, user="bob", agent="codex-cli", mode="local_agent"), alert("c", 3, "freeze_violation", "high", 60, "declared_agent", "claude-code", user="a|b", clues=[("style.head", 5)]), alert("c", 4, "agent_ended", "high", 60, "declared_agent", "?guess", user="a|b"),
    alert("d", 5, "info", "info", 41, "human", user=None),
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("alerts") / "alerts.jsonl"
    path.write_text("\n".join(map(json.dumps, ALERTS)) + "\n\nnoise\n")
    return records.report_rows(records.alerts(spark, str(path)))


def at(minute):
    return datetime(2026, 9, 14, 10, minute, tzinfo=timezone.utc)


def test_sessions_in_order(rows):
    got = report.sessions(rows).collect()
    assert [r.session_id for r in got] == ["b", "a", "c", "d"]  # 75 at 10:01, 75 at 10:02, 60, 41
    b, a, c, _ = got
    assert (b.alerts, b.last_event, b.max_level, b["class"], b.agent, b.clues) == (2, "agent_detected", "alert", "suspected_agent", "?id", ["rhythm.burst", "style.head"])
    assert (a.mode, c.freeze, c.agent, c["class"]) == ("local_agent", True, "claude-code", "declared_agent")


def test_spans_and_levels(rows):
    ids = lambda **k: sorted({r.session_id for r in report.selected(rows, **k).collect()})
    assert ids(since=at(3)) == ["b", "c", "d"] and ids(until=at(3)) == ["a", "b"] and ids(since=at(2), until=at(3)) == ["a"]
    assert ids(min_level="alert") == ["a", "b", "c"] and ids(session="c") == ["c"]
    assert report.moment("2d", at(0)) == datetime(2026, 9, 12, 10, 0, tzinfo=timezone.utc) and report.moment("2026-09-14T10:03:00", at(0)) == at(3)
    assert [r.event for r in report.timeline(rows, "c").collect()] == ["freeze_violation", "agent_ended"]


def test_summary_and_formats(rows):
    s = report.summary(rows, by="account")
    assert s.totals == {"alerts": 6, "sessions": 4, "declared_agent": 1, "suspected_agent": 2, "human": 1, "high": 1, "freezes": 1}
    assert s.clues == [("style.head", 2), ("rhythm.burst", 1)] and {r.grp for r in s.top.collect()} == {"ann", "bob", "a|b", "unknown"}
    out = json.loads(report.rendered(s, "json"))
    assert [x["session_id"] for x in out["sessions"]] == ["b", "a", "c", "d"] and out["totals"] == s.totals and {x["grp"] for x in out["agents"]} == {"?id", "codex-cli", "claude-code", "unknown"}
    assert "| a\\|b |" in report.rendered(s, "markdown") and "BY ACCOUNT" in report.rendered(s, "text")
    with pytest.raises(ValueError, match="format"):
        report.rendered(s, "html")
    none = report.summary(report.selected(rows, since=at(30)))
    assert none.totals["sessions"] == 0 and json.loads(report.rendered(none, "json"))["sessions"] == []
