"""From logs to alerts in one batch: readers, sessions, verdicts, the alert policy, and alerts as they are written."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.config import Config, duration
from tallyhound.functions.cron import occurrences
from tallyhound.functions import text
from tallyhound.operators import correlate, detect, policy, running, score
from tallyhound.operators.joins import in_first_interval
from tallyhound.operators.sessions import session_id
from tallyhound.sources import audit_log, records, rules, sshd_log
from tallyhound.sources.tables import stored

#: The schema's name in each alert that is written.
SCHEMA = "tallyhound.alert/1"
#: What names a verdict: its session, and the place of its event among all.
MOMENT = [*detect.TRACK, "seq"]
#: What an alert's reader may do, by event.
HINTS = {"freeze_violation": "a change freeze holds", "agent_declared": "declared, for information", "agent_high": "review the session now"}


def micros(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def read_events(spark: SparkSession, *, server: list[str] = (), audit: list[str] = (), recorded: list[str] = (), host: str | None = None, now: Column | None = None) -> DataFrame:
    """Events of server logs, audit logs and recordings, with the host they are of.

    Audit records do not name their machine: `host` does, and then holds for all that is read. Without audit logs it may
    be left out; a server log's lines then say it.
    """
    if audit and host is None:
        raise ValueError("audit records do not name their machine: give the host")
    read = lambda paths: spark.read.text(list(paths))
    parts = []
    if server:
        parts.append(sshd_log.events(read(server), now))
    if audit:
        parts.append(audit_log.events(read(audit)))
    parts += [records.recorded_events(spark, path)[0] for path in recorded]
    if not parts:
        raise ValueError("nothing to read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("host", F.lit(host) if host is not None else F.coalesce(F.try_element_at("fields", F.lit("host")), F.lit("")))


def freezes(config: Config, first: int, last: int) -> list[tuple[str, int, int]]:
    """(name, start, end) of the freeze windows that touch a span of time, in the order of the settings."""
    at = lambda us: datetime.fromtimestamp(us / 1e6, timezone.utc).replace(tzinfo=None)
    out = []
    for f in config.freeze:
        length = duration(f.duration)
        out += [(f.name, a, b) for a, b in occurrences(f.cron, micros(length), at(first) - length, at(last) + timedelta(minutes=1))]
    return out


def frozen(verdicts: DataFrame, config: Config) -> DataFrame:
    """verdicts with freeze and until: the first window of the settings that holds at their time, else an empty name.

    A freeze does not touch declared sessions where it exempts them.
    """
    first, last = verdicts.agg(F.min("us"), F.max("us")).first() if config.freeze else (None, None)
    windows = freezes(config, first, last) if first is not None else []
    none = verdicts.withColumns({"freeze": F.lit(""), "until": F.lit(None).cast("long")})
    if not windows:
        return none
    exempt = [f.name for f in config.freeze if f.exempt_declared]
    at = [*MOMENT, "us"]
    out = none
    for rows, those in ((verdicts.filter("declared"), [w for w in windows if w[0] not in exempt]), (verdicts.filter("NOT declared"), windows)):
        if those:
            some = in_first_interval(rows.select(*at), those).select(*MOMENT, F.col("interval").alias("_f"), F.col("end_us").alias("_u"))
            out = out.join(some, MOMENT, "left").withColumns({"freeze": F.coalesce("_f", "freeze"), "until": F.coalesce("_u", "until")}).drop("_f", "_u")
    return out


def told(contents: DataFrame, config: Config, pack: rules.Pack) -> DataFrame:
    """Alerts (records.ALERT) that sessions' contents (correlate.contents()) give, each at the event that led to it.

    Every event gives a verdict; the alert policy tells what of these is told; and for what is told the session as it was
    then is judged again with its reasons and their evidence, its commands and users shown as the settings allow. A session that
    was told of alert or above and has been idle for the window before the last event of all is told to have ended. Empty
    contents give no alert.
    """
    contents = stored(contents, "session-contents")
    limits, gap = (config.info, config.alert, config.high), micros(duration(config.window))
    heard = running.verdicts(contents, pack, limits).filter("rank > 0 OR declared")
    last = contents.groupBy(*detect.TRACK).agg(F.max(F.struct("us", "seq")).alias("l")).select(*detect.TRACK, "l.us", "l.seq", F.lit(0).alias("rank"), F.lit(False).alias("declared"))  # what an end is counted from
    v = stored(frozen(stored(heard.select(*MOMENT, "us", "rank", "declared"), "verdicts"), config).unionByName(last, allowMissingColumns=True).fillna({"freeze": ""}), "frozen-verdicts")
    now = contents.agg(F.max("us")).first()[0]
    said = policy.alerts(v, key=detect.TRACK, cadence=micros(duration(config.cadence)), ended=gap, now=now)
    said = stored(said.withColumnsRenamed({"us": "_us", "rank": "_rank"}).join(v.filter("freeze <> ''").select(*MOMENT, "freeze", "until").distinct(), MOMENT, "left").fillna({"freeze": ""}), "said")
    moments = said.select(*detect.TRACK, F.col("_us").alias("at"), F.col("seq").alias("at_seq")).distinct()
    then = detect.verdicts(correlate.tracks_at(contents, moments), pack, limits, key=[*detect.TRACK, "at", "at_seq"], command_text=config.command_text)
    a = said.withColumnsRenamed({"seq": "at_seq"}).withColumn("at", F.col("_us")).join(then.drop("level"), [*detect.TRACK, "at", "at_seq"])
    a = a.withColumn("user", text.pseudonym(F.col("user"), config.salt)) if config.salt else a
    level = score.level(F.col("_rank"))
    hint = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), F.col("event")), F.lit(""))
    time = lambda us: F.timestamp_micros(F.col(us))
    reasons = F.transform(F.filter("details", lambda d: F.array_contains("reasons", d["clue"])), lambda d: F.struct(d["clue"].alias("clue"), d["category"].alias("category"), d["weight"].alias("weight"), d["evidence"].alias("evidence"), time("_us").alias("ts")))
    out = a.select(
        F.lit(SCHEMA).alias("schema"), time("_us").alias("ts"), "host", "event", "class", "mode", "user", "src_ip", F.col("fp").alias("key_fingerprint"), "agent", F.col("score").cast("int").alias("score"), level.alias("level"), reasons.alias("reasons"),
        F.transform("suppressed", lambda s: F.struct(s["profile"].alias("profile"), s["clue"].alias("clue"), s["weight"].alias("weight"), F.lit("profile").alias("reason"))).alias("suppressed"),
        session_id(*map(F.col, detect.TRACK)).alias("session_id"), F.col("connections").cast("int").alias("connections"), F.struct(time("first_us").alias("start"), time("last_us").alias("end"), F.col("execs").cast("int").alias("execs")).alias("window"),
        F.when(F.col("freeze") != "", F.struct(F.col("freeze").alias("name"), time("until").alias("until"), level.alias("level"))).alias("freeze_window"), hint.alias("actions_hint"),
    )
    return out.filter(F.col("_rank") >= records.RANKS[config.min_level]) if config.min_level != "none" else out


def alerts_of(events: DataFrame, config: Config, pack: rules.Pack) -> DataFrame:
    """The alerts that events give under the settings and a rule pack."""
    found, _ = correlate.contents(events, gap=micros(duration(config.window)))
    return told(found, config, rules.enabled(pack, config.profiles) if config.profiles else pack)
