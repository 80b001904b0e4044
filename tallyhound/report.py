"""What an alert file tells over a span of time: totals, groups, clues, the sessions in order, and one session's timeline."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.config import duration
from tallyhound.operators.sessions import folded
from tallyhound.plans.reporting import top_by
from tallyhound.sources import records, sinks

#: What groups are made by, and how many clues are listed.
DIMENSIONS = {"account": "user", "server": "host", "agent": "agent", "key": "key_fingerprint"}
CLUES = 5


def moment(said: str, now: datetime) -> datetime:
    """A time in ISO form (UTC where it names no zone), or a length of time before now, as in 7d."""
    try:
        at = datetime.fromisoformat(said)
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    except ValueError:
        return now - duration(said)


def selected(rows: DataFrame, *, since: datetime | None = None, until: datetime | None = None, session: str = "", min_level: str = "none") -> DataFrame:
    """Alerts (records.report_rows()) of a span, the end excluded, of one session, and of a level or above."""
    at = lambda d: F.lit((d - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1))
    out = rows if since is None else rows.filter(F.col("us") >= at(since))
    out = out if until is None else out.filter(F.col("us") < at(until))
    out = out.filter(F.col("session_id") == session) if session else out
    return out.filter(F.col("rank") >= records.RANKS[min_level]) if min_level != "none" else out


def sessions(rows: DataFrame) -> DataFrame:
    """One row for each session of alerts: who and where, its span, its highest score and level, its class and agent, its clues.

    Its mode is that of the first alert with the highest score. In order of score, then of the first alert, then of the id.
    """
    at = F.struct("us", "seq")
    best = F.struct(F.col("score"), (-F.col("us")).alias("a"), (-F.col("seq")).alias("b"))
    clues = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.filter(F.coalesce("reasons", F.array().cast(rows.schema["reasons"].dataType)), lambda r: r["weight"] > 0), lambda r: r["clue"])))))
    about = rows.groupBy("session_id").agg(
        *[F.min_by(c, at).alias(c) for c in ("host", "user", "src_ip", "key_fingerprint")], F.max_by("mode", best).alias("mode"), F.max(F.coalesce("connections", F.lit(0))).alias("connections"), clues.alias("clues"), F.bool_or(F.col("event") == "freeze_violation").alias("freeze"),
    )
    found = folded(rows).drop("in_freeze").join(about, "session_id")
    level = F.element_at(F.create_map(*[F.lit(x) for k, v in records.RANKS.items() for x in (v, k)]), F.col("max_rank"))
    found = found.select(
        "session_id", "host", "user", "src_ip", F.col("key_fingerprint").alias("key"), "mode", F.timestamp_micros("first_us").alias("first"), F.timestamp_micros("last_us").alias("last"), "alerts", "last_event", "max_score", level.alias("max_level"),
        "connections", "class", "agent", "freeze", "clues",
    )
    return found.orderBy(F.desc("max_score"), "first", "session_id")


def timeline(rows: DataFrame, session: str) -> DataFrame:
    return rows.filter(F.col("session_id") == session).orderBy("ts", "seq").select("ts", "event", "level", "score", F.transform(F.coalesce("reasons", F.array().cast(rows.schema["reasons"].dataType)), lambda r: r["clue"]).alias("clues"))


@dataclass
class Summary:
    """The parts of a report; tables stay tables, but for totals and the first few clues."""

    totals: dict[str, int]
    by: str
    top: DataFrame
    agents: DataFrame
    clues: list[tuple[str, int]]
    sessions: DataFrame


def summary(rows: DataFrame, *, by: str = "account", top: int = 10) -> Summary:
    """The report of selected() alerts, grouped by account, server, agent or key; top 0 is all groups."""
    found = sessions(rows)
    dim = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    of: dict[str, Column] = {k: dim({"key_fingerprint": "key"}.get(c, c)) for k, c in DIMENSIONS.items()}
    count = lambda c, v: F.count_if(F.col(c) == v)
    kinds = {v: count("class", v) for v in ("declared_agent", "suspected_agent", "human")} | {"high": count("max_level", "high"), "freezes": F.count_if("freeze")}
    totals = found.agg(F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"), F.count("*").alias("sessions"), *[c.alias(k) for k, c in kinds.items()]).first().asDict()
    clues = found.select(F.explode("clues").alias("clue")).groupBy("clue").count().orderBy(F.desc("count"), "clue").limit(CLUES).collect()
    return Summary(totals, by, top_by(found, of[by], top), top_by(found, of["agent"]), [(r.clue, r["count"]) for r in clues], found)


def _aligned(df: DataFrame) -> str:
    rows = [list(df.columns), *[["" if x is None else str(x) for x in r] for r in df.toLocalIterator()]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in rows)


def rendered(s: Summary, form: str = "text", *, listed: int = 50) -> str:
    """The report as text, markdown or json. `listed` bounds how many sessions are shown; all are in Summary.sessions."""
    first = s.sessions.limit(listed)
    shown = first.withColumn("clues", F.array_join("clues", " ")).select("session_id", "user", "host", "src_ip", "max_score", "max_level", "class", "agent", "alerts", "first", "last", "clues")
    if form == "json":
        lines = lambda df: [json.loads(r.x) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("x")).toLocalIterator()]
        return json.dumps({"totals": s.totals, "by": s.by, "top": lines(s.top), "agents": lines(s.agents), "top_clues": [{"clue": c, "sessions": n} for c, n in s.clues], "sessions": lines(first)}, indent=2)
    if form not in ("text", "markdown"):
        raise ValueError(f"no such format: {form!r}")
    table, head = (_aligned, str.upper) if form == "text" else (sinks.markdown, lambda t: f"## {t.capitalize()}\n")
    said = ", ".join(f"{v} {k.replace('_', ' ')}" for k, v in s.totals.items())
    clues = "\n".join(f"{'- ' if form == 'markdown' else ''}{c}: {n}" for c, n in s.clues)
    return "\n".join([head("totals"), said, "", head(f"by {s.by}"), table(s.top), "", head("agents"), table(s.agents), "", head("clues"), clues, "", head("sessions"), table(shown)]).rstrip() + "\n"
