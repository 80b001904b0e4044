"""Scans of processes in a stream: each host's last scan is the state, and the next one is told by what differs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhound.operators import snapshots

OUT = "host string, us long, kind string, user string, pid int, ses int, fields string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def told(prev: dict[int, dict], scan: list[dict], at: int, refresh: int) -> tuple[list[tuple], dict[int, dict]]:
    """(events of a scan, what is known after it): (kind, process) for what is new or due, then for what is gone, by number."""
    out, gone, now = [], [], {}
    for p in sorted(scan, key=lambda p: (p["pid"], p["start_ticks"], p["fields"])):
        if p["pid"] in now:
            continue
        old = prev.get(p["pid"])
        if old is not None and old["start_ticks"] != p["start_ticks"]:
            gone.append(old)
            old = None
        due = old is None or at - old["told"] >= refresh
        if due:
            out.append(("proc.seen", p))
        now[p["pid"]] = p | {"told": at if due else old["told"]}
    gone += [p for pid, p in prev.items() if pid not in now]
    return out + [("proc.gone", p) for p in sorted(gone, key=lambda p: p["pid"])], now


class Scans(StatefulProcessor):
    """Events of one host's scans; a scan is looked at once the watermark has passed it, when all of it has come."""

    def __init__(self, refresh: int):
        self.refresh = refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows string")
        self.known = handle.getMapState("known", "pid int", "process string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        met: dict[int, list] = {}
        for frame in rows:
            for at, pid, start, ses, user, fields in zip(frame["at"], frame["pid"], frame["start_ticks"], frame["ses"], frame["user"], frame["fields"]):
                scan = met.setdefault(int(at), [])
                if not pd.isna(pid):
                    scan.append({"pid": int(pid), "start_ticks": int(start), "ses": int(ses), "user": user, "fields": fields})
        for at, scan in met.items():
            held = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (json.dumps(held + scan),))
            self.handle.registerTimer(at // 1000 + 1)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until, out = expiredTimerInfo.getExpiryTimeInMs(), []
        known = {int(pid): json.loads(p) for (pid,), (p,) in self.known.iterator()}
        for at in sorted(int(k[0]) for k in self.waiting.keys() if int(k[0]) // 1000 + 1 <= until):  # noqa: SIM118
            events, known = told(known, json.loads(self.waiting.getValue((at,))[0]), at, self.refresh)
            out += [(key[0], at, kind, p["user"], p["pid"], p["ses"], p["fields"]) for kind, p in events]
            self.waiting.removeKey((at,))
        self.known.clear()
        for pid, p in known.items():
            self.known.updateValue((pid,), (json.dumps(p),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def process_events_stream(rows: DataFrame, *, refresh: int = snapshots.REFRESH, late: str = "10 seconds") -> DataFrame:
    """snapshots.process_events() of a stream of snapshots.PROCESS rows; a scan that found nothing is a row without pid.

    The session needs the RocksDB state store (streaming.audit.with_states()).
    """
    r = rows.select(*snapshots.PROCESS).withColumn("fields", F.to_json("fields")).withColumn("ts", F.timestamp_micros("at")).filter("host IS NOT NULL")
    found = r.withWatermark("ts", late).groupBy("host").transformWithStateInPandas(Scans(refresh), OUT, "Append", "EventTime")
    e = found.withColumn("fields", F.from_json("fields", "map<string,string>"))
    e = e.withColumn("fields", F.when(F.col("kind") == "proc.gone", snapshots.gone_fields(F.col("fields"))).otherwise(F.col("fields")))
    return e.select(F.timestamp_micros("us").alias("ts"), "kind", F.lit("procfs").alias("source"), "user", F.lit("").alias("src_ip"), F.lit(0).alias("src_port"), "pid", "ses", "fields", "host")
