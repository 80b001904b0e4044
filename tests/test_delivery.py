"""Each alert once for each receiver, whatever fails and is repeated."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tallyhound.sources import delivery, sinks

ALERT = "session_id string, event string, ts timestamp, level string, score int, user string, host string, src_ip string, reasons array<struct<clue:string,weight:int,evidence:string>>"


class Inbox:
    """A receiver on this machine. Answers: by number of the request for a user."""

    def __init__(self):
        self.got, self.answers = [], {}
        inbox = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                inbox.got.append((self.path, self.headers["Idempotency-Key"], body))
                tries = sum(g[0] == self.path and g[1] == self.headers["Idempotency-Key"] for g in inbox.got)
                codes = inbox.answers.get(body.get("user"), [])
                self.send_response(codes[min(tries, len(codes)) - 1] if codes else 200)
                self.end_headers()

            def log_message(self, *args):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def inbox():
    box = Inbox()
    yield box
    box.server.shutdown()


def alerts(spark, *users, level="alert"):
    rows = [(f"s{u}", "agent_detected", None, level, 75, u, "web", "10.0.0.3", [("style.head", 5, "x" * 3000)]) for u in users]
    return spark.createDataFrame(rows, ALERT)


def arrived(inbox, path):
    return sorted(b["user"] for p, _, b in inbox.got if p == path)


def test_a_repeated_batch_sends_nothing_twice(spark, inbox, tmp_path):
    one = delivery.Receiver("one", delivery.webhook(inbox.url + "/one"), "info", waits=(0.01, 0.01))

    def broken(key, body):
        raise SystemExit("killed")  # takes the task, and so the batch, with it

    batch = alerts(spark, "ann", "bob", "ann").unionByName(alerts(spark, "zoe", level="info"))
    first = delivery.Ledgered(str(tmp_path), [one, delivery.Receiver("two", broken, "alert")], tasks=2)
    with pytest.raises(Exception):  # noqa: B017
        first(batch, 0)
    assert arrived(inbox, "/one") == ["ann", "bob", "zoe"]
    two = delivery.Receiver("two", delivery.webhook(inbox.url + "/two"), "alert", waits=(0.01, 0.01))
    again = delivery.Ledgered(str(tmp_path), [one, two], tasks=2)
    for _ in range(2):
        again(batch, 0)
    again(alerts(spark, "bob", "cas"), 1)
    assert arrived(inbox, "/one") == ["ann", "bob", "cas", "zoe"] and arrived(inbox, "/two") == ["ann", "bob", "cas"]
    assert again.counts == {"one": {"sent": 4}, "two": {"sent": 3}}


def test_what_may_pass_is_tried_again_and_a_refusal_is_not(spark, inbox, tmp_path):
    inbox.answers = {"ann": [503, 429, 200], "bob": [400], "cas": [500]}
    handler = delivery.Ledgered(str(tmp_path), [delivery.Receiver("r", delivery.webhook(inbox.url + "/r"), waits=(0.01, 0.01))])
    handler(alerts(spark, "ann", "bob", "cas", "dan"), 0)
    assert arrived(inbox, "/r") == ["ann"] * 3 + ["bob"] + ["cas"] * 3 + ["dan"]
    states = sorted((r.state, r.attempts) for r in handler.entries(spark).collect())
    assert states == [("lost", 1), ("lost", 3), ("sent", 1), ("sent", 3)]
    handler(alerts(spark).limit(0), 1)
    assert json.loads(delivery.dumped(handler.entries(spark)))[0] == {"sink": "r", "state": "lost", "n": 2, "attempts": 4}


def test_settings_are_checked_as_a_whole(spark):
    assert [(r.name, r.level, r.kind) for r in delivery.receivers([{"url": "https://x", "kind": "slack", "level": "high"}, {"url": "http://y", "name": "b"}])] == [("sink-0", "high", "slack"), ("b", "info", "generic")]
    with pytest.raises(ValueError, match="no url; .*kind 'fax'; .*unknown settings"):
        delivery.receivers([{"name": "a"}, {"url": "https://x", "kind": "fax"}, {"url": "https://x", "color": 1}])
    embed = json.loads(alerts(spark, "ann").select(sinks.payload("discord").alias("x")).first().x)["embeds"][0]
    assert len(embed["fields"][0]["value"]) == sinks.LIMITS["field"] and embed["fields"][0]["name"] == "style.head"
