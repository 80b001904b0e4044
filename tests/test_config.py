import json
from datetime import timedelta

import pytest

from tallyhound import __main__ as cli
from tallyhound import config


def test_durations():
    assert config.duration("1d12h") == timedelta(hours=36) and config.duration("250ms") == timedelta(milliseconds=250) and config.duration("90") == timedelta(seconds=90)
    with pytest.raises(ValueError):
        config.duration("1 day")


def test_settings():
    got = config.load(json.dumps({"info": 30, "freeze": [{"name": "n", "cron": "0 22 * * *", "duration": "8h"}]}))
    assert got.info == 30 and got.freeze[0].name == "n" and config.load(config.shown(got)) == got
    for bad in ({"colour": 1}, {"info": 80}, {"window": "0s"}, {"freeze": [{"name": "n", "cron": "x", "duration": "8h"}]}, {"command_text": "some"}):
        with pytest.raises(ValueError):
            config.load(json.dumps(bad))


def test_rules_command(capsys):
    assert cli.main(["rules"]) == 0 and "banners paramiko" in capsys.readouterr().out


def test_report_command(spark, tmp_path, capsys):
    (tmp_path / "alerts.jsonl").write_text(json.dumps({"schema": "v1", "ts": "2026-09-14T08:00:00Z", "session_id": "s1", "level": "high", "score": 91, "user": "ann", "host": "h", "event": "agent_high", "class": "suspected_agent"}) + "\n")
    assert cli.main(["report", str(tmp_path / "alerts.jsonl")]) == 0 and "ann" in capsys.readouterr().out


def test_sinks_are_checked_with_the_settings():
    assert config.load('{"sinks": [{"url": "https://hooks.example.com/x", "kind": "teams", "level": "high"}]}').sinks[0]["kind"] == "teams"
    with pytest.raises(ValueError, match="no url.*|two sinks"):
        config.load('{"sinks": [{"name": "a"}]}')
