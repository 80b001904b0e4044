"""Where alerts go: files, a console, chat hooks, mail, the system log, and counters for a monitor.

Payloads are column expressions, so they are made where the rows are. Delivery takes place in foreachBatch on a few
rows, through a function that the caller gives.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.text import chat_escaped, slack_escaped
from tallyhound.sources.records import RANKS

#: Severities of the system log by level, its facilities, and a chat service's limits.
SEVERITY = {"info": 6, "alert": 4, "high": 1}
FACILITIES = {f: k for k, f in enumerate("kern user mail daemon auth syslog lpr news uucp cron authpriv ftp".split())} | {f"local{k}": 16 + k for k in range(8)}
LIMITS = {"content": 2000, "title": 256, "description": 4096, "field": 1024, "fields": 25}
RETRY = (2.0, 8.0)


class Transient(Exception):
    """A failure that may pass: the delivery is tried again."""


def at_least(rows: DataFrame, level: str) -> DataFrame:
    return rows.filter(F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("level")) >= RANKS[level])


def headline(escape: Callable[[Column], Column] = lambda c: c) -> Column:
    part = lambda c: escape(F.coalesce(F.col(c), F.lit("")))
    return F.concat(F.upper("level"), F.lit(": "), part("user"), F.lit("@"), part("host"), F.lit(" from "), part("src_ip"), F.lit(" scored "), F.col("score").cast("string"), F.lit(" ("), part("event"), F.lit(")"))


def payload(kind: str, columns: list[str] | None = None) -> Column:
    """The body of a hook: generic is the alert itself (its `columns`), the others speak three chat services' dialects."""
    if kind == "generic":
        return F.to_json(F.struct(*(columns or ["*"])))
    lines = F.transform("reasons", lambda r: F.concat(r["clue"], F.lit(" +"), r["weight"].cast("string"), F.lit(" "), F.coalesce(r["evidence"], F.lit(""))))
    if kind == "slack":
        return F.to_json(F.struct(F.concat_ws("\n", headline(slack_escaped), F.transform(lines, slack_escaped)).alias("text")))
    if kind == "teams":
        return F.to_json(F.struct(F.lit("MessageCard").alias("@type"), F.lit("http://schema.org/extensions").alias("@context"), headline(chat_escaped).alias("title"), F.array_join(F.transform(lines, chat_escaped), "\n\n").alias("text")))
    if kind == "discord":
        reason = lambda r: F.struct(F.substring(chat_escaped(r["clue"]), 1, LIMITS["title"]).alias("name"), F.substring(chat_escaped(F.concat(r["weight"].cast("string"), F.lit(" "), F.coalesce(r["evidence"], F.lit("")))), 1, LIMITS["field"]).alias("value"))
        embed = F.struct(
            F.substring(headline(chat_escaped), 1, LIMITS["title"]).alias("title"), F.substring(F.array_join(F.transform(lines, chat_escaped), "\n"), 1, LIMITS["description"]).alias("description"),
            F.transform(F.slice("reasons", 1, LIMITS["fields"]), reason).alias("fields"),
        )
        return F.to_json(F.struct(F.substring(headline(chat_escaped), 1, LIMITS["content"]).alias("content"), F.array(embed).alias("embeds")))
    raise ValueError(f"unknown payload {kind!r}")


def syslog_line(facility: str = "authpriv") -> Column:
    severity = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("level")), F.lit(6))
    return F.concat(F.lit("<"), (severity + 8 * FACILITIES[facility]).cast("string"), F.lit(">"), F.to_json(F.struct("*")))


def mail(alert: dict, sender: str, to: list[str]) -> str:
    """A plain-text message; line breaks never reach a header."""
    one = lambda s: str(s).replace("\r", " ").replace("\n", " ")
    head = [f"From: {one(sender)}", f"To: {one(', '.join(to))}", f"Subject: {one(alert.get('level', '')).upper()} {one(alert.get('user', ''))}@{one(alert.get('host', ''))} score {alert.get('score')}", "Content-Type: text/plain; charset=utf-8"]
    body = [f"{k}: {v}" for k, v in alert.items() if k != "reasons"] + [f"  {r['clue']} {r['weight']:+d} {r.get('evidence') or ''}" for r in alert.get("reasons") or []]
    return "\r\n".join([*head, "", *body, ""])


@dataclass
class Delivery:
    """Sends each payload of a batch, trying again after a failure that may pass; counts what was sent and lost."""

    send: Callable[[str], None]
    level: str = "info"
    kind: str = "generic"
    waits: tuple[float, ...] = RETRY
    sleep: Callable[[float], None] = time.sleep
    sent: int = 0
    lost: int = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for row in at_least(batch, self.level).select(payload(self.kind).alias("body")).toLocalIterator():
            for wait in (*self.waits, None):
                try:
                    self.send(row.body)
                    self.sent += 1
                    break
                except Transient:
                    if wait is None:
                        self.lost += 1
                    else:
                        self.sleep(wait)
                except Exception:  # noqa: BLE001  a permanent failure of one alert does not hold up the others
                    self.lost += 1
                    break


def append_json(path: str) -> Callable[[DataFrame, int], None]:
    """Appends each batch as JSON lines, one set of files a batch: what rotation by size does elsewhere."""
    return lambda batch, batch_id: batch.write.mode("append").json(path)


def console(batch: DataFrame, batch_id: int) -> None:
    for line in batch.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        print(line.line)


def exposition(counts: dict[str, dict[tuple[tuple[str, str], ...], float]], helps: dict[str, str]) -> str:
    """Counters in the text format that monitors scrape, by name and then by labels."""
    escape = lambda s: s.replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')
    out = []
    for name in sorted(counts):
        out += [f"# HELP {name} {helps.get(name, name)}", f"# TYPE {name} {'counter' if name.endswith('_total') else 'gauge'}"]
        for labels, number in sorted(counts[name].items()):
            said = ",".join(f'{k}="{escape(v)}"' for k, v in labels)
            out.append(f"{name}{'{' + said + '}' if said else ''} {json.dumps(number) if number != int(number) else int(number)}")
    return "\n".join(out) + "\n"


def event_counts(events: DataFrame) -> dict[str, dict[tuple[tuple[str, str], ...], float]]:
    kinds = events.groupBy("kind").count().collect()  # as many rows as there are kinds
    return {"events_total": {(("kind", r["kind"]),): float(r["count"]) for r in kinds}}


def markdown(df: DataFrame) -> str:
    """A small result, such as a report's groups, as a Markdown table; cells are escaped where the rows are."""
    from tallyhound.functions.text import markdown_escaped

    cells = df.select(*[markdown_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])
    rows = ["| " + " | ".join(r) + " |" for r in cells.toLocalIterator()]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *rows]) + "\n"


def explanation() -> Column:
    """One sentence on a verdict (score, level, class, agent, reasons), for people."""
    who = F.when(F.col("class") == "declared_agent", F.concat(F.lit("says it is "), F.col("agent"))).when(F.col("class") == "suspected_agent", F.concat(F.lit("looks like "), F.when(F.col("agent") != "", F.col("agent")).otherwise("an unknown tool"))).otherwise("looks like a person")
    why = F.when(F.size("reasons") > 0, F.concat(F.lit(" because of "), F.array_join(F.slice("reasons", 1, 5), ", "))).otherwise("")
    return F.concat(F.lit("This session "), who, F.lit(" (score "), F.col("score").cast("string"), F.lit(", "), F.col("level"), F.lit(")"), why, F.lit("."))
