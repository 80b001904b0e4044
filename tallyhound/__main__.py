"""python -m tallyhound run|live|report|score|rules|query ...: the library from a shell."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound import config as settings
from tallyhound import report as reports
from tallyhound.functions import text
from tallyhound.operators import correlate, detect
from tallyhound.operators.correlate import SESSION
from tallyhound.operators.score import level as score_level
from tallyhound.operators.sessions import session_id
from tallyhound.run import SCHEMA, alerts_of, read_events
from tallyhound.sources import delivery, records, rules, sinks
from tallyhound.streaming.service import Service


def _pack(args: argparse.Namespace) -> rules.Pack:
    return rules.load(args.rules) if args.rules else rules.default_pack()


def written(df: DataFrame) -> None:
    """All rows of df, tab-separated below their names, one partition at a time on the driver."""
    print(*df.columns, sep="\t")
    for row in df.toLocalIterator():
        print(*row, sep="\t")


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    """What an alert file tells over a span, or one session's timeline."""
    now = datetime.now(timezone.utc)
    at = lambda said: reports.moment(said, now) if said else None
    rows = records.report_rows(records.alerts(spark, args.alerts))
    chosen = reports.selected(rows, since=at(args.since), until=at(args.until), session=args.session, min_level=args.min_level)
    if args.session:
        written(reports.timeline(chosen, args.session))
        return
    print(reports.rendered(reports.summary(chosen, by=args.by, top=args.top), args.format), end="")


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    """Verdicts of a file of recorded events."""
    events, skipped = records.recorded_events(spark, args.events)
    pack = rules.enabled(_pack(args), args.profile) if args.profile else _pack(args)
    written(detect.verdicts(correlate.tracks(events, gap=None), pack).orderBy(F.desc("score")).select("user", "src_ip", "score", "level", "class", "mode", "agent", "profile", "reasons", "evidence"))
    print(f"{skipped.count()} events without a time", file=sys.stderr)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Alerts of logs, appended to a folder as JSON lines, or printed."""
    config = settings.load(args.config.read_text()) if args.config else settings.Config()
    events = read_events(spark, server=args.server, audit=args.audit, recorded=args.events, host=args.host)
    found = alerts_of(events, config, _pack(args))
    (sinks.append_json(args.out) if args.out else sinks.console)(found, 0)


def live(spark: SparkSession, args: argparse.Namespace) -> None:
    """Alerts of logs that keep arriving, for ever or (--once) of what there is; to a folder, or to the settings' sinks."""
    config = settings.load(args.config.read_text()) if args.config else settings.Config()
    if args.audit and not args.host:
        raise SystemExit("audit records do not name their machine: give --host")
    now = int(datetime.now(timezone.utc).timestamp()) * 1_000_000
    year = 366 * 24 * 3600 * 1_000_000
    deliver = delivery.Ledgered(f"{args.state}/delivery", delivery.receivers(config.sinks)) if config.sinks else sinks.append_json(args.out) if args.out else sinks.console
    queries = Service(spark, args.state, args.server, [(x, args.host) for x in args.audit], config, _pack(args), told(deliver, config), (now - year, now + year)).start(once=args.once)
    for q in [] if args.once else queries:
        q.awaitTermination()


def told(deliver: Callable[[DataFrame, int], None], config: settings.Config) -> Callable[[DataFrame, int], None]:
    """deliver for batches of a service's alerts, with the columns that receivers are told of."""

    def run(batch: DataFrame, batch_id: int) -> None:
        user = text.pseudonym(F.col("user"), config.salt) if config.salt else F.col("user")
        reasons = F.array().cast("array<struct<clue:string,weight:int,evidence:string>>")
        said = F.when(F.col("event") == "agent_declared", "declared_agent").when(F.col("rank") >= 2, "suspected_agent").otherwise("human")
        out = batch.select(
            F.lit(SCHEMA).alias("schema"), F.timestamp_micros("us").alias("ts"), "host", "event", said.alias("class"), user.alias("user"), "src_ip", F.col("fp").alias("key_fingerprint"), "score",
            score_level(F.col("rank")).alias("level"), reasons.alias("reasons"), session_id(*map(F.col, SESSION)).alias("session_id"),
        )
        deliver(out, batch_id)

    return run


def show_rules(args: argparse.Namespace) -> int:
    pack = _pack(args)
    for rule in rules.listed(pack):
        print(rule["section"], rule["id"])
    found = rules.problems(pack)
    print(*found, sep="\n", file=sys.stderr)
    return 1 if found else 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tallyhound")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report")
    r.add_argument("alerts")
    r.add_argument("--by", choices=["account", "server", "agent", "key"], default="account")
    r.add_argument("--since", default="")
    r.add_argument("--until", default="")
    r.add_argument("--format", choices=["text", "markdown", "json"], default="text")
    r.add_argument("--session", default="")
    r.add_argument("--min-level", choices=list(records.RANKS), default="none")
    r.add_argument("--top", type=int, default=10)
    s = sub.add_parser("score")
    s.add_argument("events")
    s.add_argument("--profile", action="append")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("folder")
    v = sub.add_parser("rules")
    u = sub.add_parser("run")
    for name in ("--server", "--audit", "--events"):
        u.add_argument(name, nargs="+", default=[])
    u.add_argument("--host")
    u.add_argument("--config", type=Path)
    u.add_argument("--out", default="")
    w = sub.add_parser("live")
    for name in ("--server", "--audit"):
        w.add_argument(name, nargs="+", default=[])
    w.add_argument("--host")
    w.add_argument("--config", type=Path)
    w.add_argument("--state", required=True)
    w.add_argument("--out", default="")
    w.add_argument("--once", action="store_true")
    for p in (s, u, v, w):
        p.add_argument("--rules", type=Path)
    args = top.parse_args(argv)
    if args.command == "rules":
        return show_rules(args)
    spark = SparkSession.builder.appName("tallyhound").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        from tallyhound.catalogue import QUERIES

        written(QUERIES[args.name](spark, args.folder))
    else:
        {"live": live, "report": report, "run": run, "score": score}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
