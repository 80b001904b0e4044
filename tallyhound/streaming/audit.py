"""Audit records of a stream, put together into events.

An event's records share a time and a serial number, but come interleaved with others' and may be cut by a batch's end.
Each host has a map of its open groups. A group closes by its contents (an end mark, or the process title, which comes
last), by a serial number two or more above it, or by age, through a timer on the records' own time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhound.sources import audit_log

#: The age at which a group closes, in milliseconds; records that end a group; how far ahead another's serial closes it.
AGE, ENDS, AHEAD = 2000, {"EOE", "PROCTITLE"}, 2
_RECORDS = "array<struct<type:string,fields:map<string,string>,enriched:map<string,string>>>"


class Assembly(StatefulProcessor):
    """(host, us, serial, records as JSON) of each group that closes, from a host's records (type, us, serial, body)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "us long, serial string", "records string, ended boolean")

    def _close(self, host: str, keys: list[tuple[int, str]]) -> list[tuple]:
        out = []
        for us, serial in sorted(keys, key=lambda k: (k[0], int(k[1]))):
            out.append((host, us, serial, self.open.getValue((us, serial))[0]))
            self.open.removeKey((us, serial))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        met: dict[tuple[int, str], list] = {}
        for frame in rows:
            for kind, us, serial, body in zip(frame["type"], frame["us"], frame["serial"], frame["body"]):
                met.setdefault((int(us), serial), []).append((kind, body))
        # all that this batch brings goes in before anything closes: its rows are in no order
        for (us, serial), records in met.items():
            held, ended = self.open.getValue((us, serial)) if self.open.containsKey((us, serial)) else ("[]", False)
            bodies = json.loads(held) + [json.loads(b) for kind, b in records if kind != "EOE"]
            self.open.updateValue((us, serial), (json.dumps(bodies), bool(ended) or any(kind in ENDS for kind, _ in records)))
            self.handle.registerTimer(us // 1000 + AGE)
        groups = [((int(us), serial), ended) for (us, serial), (_, ended) in self.open.iterator()]
        newest = max(((us, int(serial)) for (us, serial), _ in groups), default=(0, 0))[1]  # by time: serials begin anew when a host restarts
        done = [k for k, ended in groups if ended or int(k[1]) <= newest - AHEAD]
        yield pd.DataFrame(self._close(key[0], done), columns=["host", "us", "serial", "records"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        done = [(int(us), serial) for (us, serial), _ in self.open.iterator() if int(us) // 1000 + AGE <= until]
        yield pd.DataFrame(self._close(key[0], done), columns=["host", "us", "serial", "records"])

    def close(self) -> None:
        pass


def parts(logs: DataFrame, late: str = "10 seconds") -> tuple[DataFrame, DataFrame]:
    """(log-in and log-out events, whole groups of exec calls) of a stream of lines (host, value).

    Records that come more than `late` behind the newest of all are dropped by the watermark; a record that comes after
    its group has closed makes a group of its own. The session needs the RocksDB state store (see with_states()).
    """
    r = audit_log.records(logs, "host")
    body = F.to_json(F.struct("type", "fields", "enriched"))
    shown = r.filter(F.col("type").isin(*audit_log.PARTS, "EOE")).select("host", F.timestamp_micros("us").alias("ts"), "us", F.col("serial").cast("string").alias("serial"), "type", body.alias("body"))
    groups = shown.withWatermark("ts", late).groupBy("host").transformWithStateInPandas(Assembly(), "host string, us long, serial string, records string", "Append", "EventTime")
    whole = groups.select("host", "us", F.col("serial").cast("decimal(20,0)").alias("serial"), F.from_json("records", _RECORDS).alias("records"))
    return audit_log.logins(r, "host"), audit_log.execs(whole, "host")


def with_states(spark) -> None:  # noqa: ANN001
    """The state store that timers and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
