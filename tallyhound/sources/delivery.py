"""Alerts to their receivers, so that a batch that is repeated sends nothing twice.

Every alert has an id made of what it says. A ledger beside the stream's checkpoint holds, for each receiver, the ids that
were delivered or given up, written when a receiver's part of a batch is done; a repeated batch leaves these out. Sending
takes place in tasks, each over its own alerts, with waits between attempts there and not on the driver. What a lost
executor had sent of a task that Spark then repeats may arrive again; the id goes along, so that a receiver can tell.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.sources import sinks

LEDGER = "sink string, id string, state string, attempts int, batch long"
#: What names an alert: the session, what is told of it, and when.
NAMED = ["session_id", "event", "ts", "level", "score"]


@dataclass(frozen=True)
class Receiver:
    """Where alerts of a level or above go, and in which form. send(id, body) raises sinks.Transient where another try may help."""

    name: str
    send: Callable[[str, str], None]
    level: str = "info"
    kind: str = "generic"
    waits: tuple[float, ...] = sinks.RETRY


def alert_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in NAMED]), 256), 1, 32)


def sent(rows: Iterator[tuple[str, str]], receiver: Receiver, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, str, int]]:
    """(id, state, attempts) of each (id, body): sent, or lost for good. One alert's failure does not hold up the next."""
    for key, body in rows:
        state, attempts = "lost", 0
        for wait in (*receiver.waits, None):
            attempts += 1
            try:
                receiver.send(key, body)
                state = "sent"
                break
            except sinks.Transient:
                if wait is None:
                    break
                sleep(wait)
            except Exception:  # noqa: BLE001  not to be tried again
                break
        yield key, state, attempts


@dataclass
class Ledgered:
    """A handler for foreachBatch: each receiver gets what the ledger does not yet have for it.

    path is a folder that all executors share. Alerts that are equal in all that names them are one alert. Each receiver's
    part is written when it is done, so that a batch that fails at the second receiver does not go to the first one again.
    """

    path: str
    receivers: list[Receiver]
    tasks: int = 8  # how many send at a time for one receiver
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def entries(self, spark: SparkSession) -> DataFrame:
        """The ledger so far."""
        return spark.read.schema(LEDGER).parquet(f"{self.path}/ledger") if self._there(spark) else spark.createDataFrame([], LEDGER)

    def _there(self, spark: SparkSession) -> bool:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn("_id", alert_id()).dropDuplicates(["_id"])
        for r in self.receivers:
            done = self.entries(spark).filter(F.col("sink") == r.name).select(F.col("id").alias("_id"))
            fresh = named.join(done, "_id", "left_anti")
            bodies = sinks.at_least(fresh, r.level).select("_id", sinks.payload(r.kind, [c for c in batch.columns]).alias("body"))

            def run(frames: Iterator[pd.DataFrame], r: Receiver = r) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    yield pd.DataFrame(list(sent(zip(frame["_id"], frame["body"]), r)), columns=["id", "state", "attempts"])

            told = bodies.repartition(self.tasks).mapInPandas(run, "id string, state string, attempts int")
            told = told.select(F.lit(r.name).alias("sink"), "id", "state", "attempts", F.lit(batch_id).cast("long").alias("batch"))
            told.write.mode("append").parquet(f"{self.path}/ledger")
        for x in self.entries(spark).groupBy("sink", "state").count().collect():  # two rows a receiver
            self.counts.setdefault(x["sink"], {})[x["state"]] = x["count"]


def webhook(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0) -> Callable[[str, str], None]:
    """A send function that posts the body; busy servers and broken connections are worth another try, refusals are not."""

    def send(key: str, body: str) -> None:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", "Idempotency-Key": key, **(headers or {})})  # noqa: S310
        try:
            urllib.request.urlopen(request, timeout=timeout).close()  # noqa: S310
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise sinks.Transient(str(e)) from e
            raise
        except (urllib.error.URLError, TimeoutError) as e:
            raise sinks.Transient(str(e)) from e

    return send


def receivers(settings: list[dict]) -> list[Receiver]:
    """Receivers of a settings file's list: {name, url, kind, level, headers}. All that is wrong is told at once."""
    out, wrong = [], []
    for k, s in enumerate(settings):
        if extra := set(s) - {"name", "url", "kind", "level", "headers"}:
            wrong.append(f"sink {k}: unknown settings {sorted(extra)}")
        if not str(s.get("url", "")).startswith(("http://", "https://")):
            wrong.append(f"sink {k}: no url")
        if s.get("kind", "generic") not in ("generic", "slack", "teams", "discord"):
            wrong.append(f"sink {k}: kind {s['kind']!r}")
        if s.get("level", "info") not in ("info", "alert", "high"):
            wrong.append(f"sink {k}: level {s['level']!r}")
        out.append(Receiver(s.get("name") or f"sink-{k}", webhook(s.get("url", ""), s.get("headers")), s.get("level", "info"), s.get("kind", "generic")))
    if len({r.name for r in out}) < len(out):
        wrong.append("two sinks of one name")
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def dumped(entries: DataFrame) -> str:
    """The ledger's totals by receiver and state, as JSON, for people."""
    rows = entries.groupBy("sink", "state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts")).orderBy("sink", "state").collect()
    return json.dumps([r.asDict() for r in rows])
