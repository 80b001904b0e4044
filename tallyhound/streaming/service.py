"""From log files that keep arriving to alerts: readers, sessions and alerts as streams, one after the other.

Three queries with a table of files between them, each with its own checkpoint: events of the logs, the contents of
sessions, and alerts. Every query can be stopped and started by itself; what it has done is not done again. Rounds may run
by themselves (once=True takes what there is and ends) or for ever.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhound.config import Config, duration
from tallyhound.run import freezes, micros
from tallyhound.sources import rules, sshd_log
from tallyhound.streaming import audit, counters, sessions

_EVENT = ["ts", "kind", "source", "user", "src_ip", "src_port", "pid", "ses", "fields", "host"]


@dataclass
class Service:
    """Streams of one place: folders of logs, a folder for state that all executors share, settings and rules.

    server: folders of server logs, whose lines name their host. audit: (folder, host) of audit logs, which do not.
    Freezes are laid out from `since` to `until`, in microseconds. deliver gets each batch of alerts, as in foreachBatch.
    """

    spark: SparkSession
    state: str
    server: list[str] = field(default_factory=list)
    audit: list[tuple[str, str]] = field(default_factory=list)
    config: Config = field(default_factory=Config)
    pack: rules.Pack = field(default_factory=rules.default_pack)
    deliver: Callable[[DataFrame, int], None] | None = None
    span: tuple[int, int] | None = None  # of the freezes
    late: str = "30 seconds"

    def _text(self, folder: str) -> DataFrame:
        return self.spark.readStream.text(folder)

    def _ordered(self, events: DataFrame) -> DataFrame:
        """events with a number to tell those of one time apart: the same however the stream is cut."""
        flat = [F.to_json(c) if c == "fields" else F.col(c) for c in _EVENT]
        return events.select(*_EVENT, F.xxhash64(*flat).alias("seq"))

    def streams(self) -> list[tuple[str, DataFrame]]:
        """(name, events) of every reader."""
        out = []
        for k, folder in enumerate(self.server):
            e = sshd_log.events(self._text(folder)).withColumn("host", F.coalesce(F.try_element_at("fields", F.lit("host")), F.lit("")))
            out.append((f"server-{k}", self._ordered(e)))
        for k, (folder, host) in enumerate(self.audit):
            alone, calls = audit.parts(self._text(folder).withColumn("host", F.lit(host)), self.late)
            out += [(f"logins-{k}", self._ordered(alone)), (f"calls-{k}", self._ordered(calls))]
        return out

    def _start(self, df: DataFrame, name: str, folder: str, once: bool) -> StreamingQuery:
        w = df.writeStream.format("parquet").option("path", f"{self.state}/{folder}").option("checkpointLocation", f"{self.state}/checkpoints/{name}").queryName(name)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start()

    def _again(self, schema: DataFrame, folder: str) -> DataFrame:
        return self.spark.readStream.schema(schema.schema).parquet(f"{self.state}/{folder}/")

    def start(self, *, once: bool = False) -> list[StreamingQuery]:
        """Starts all queries; with `once` each takes what there is and has ended on return."""
        audit.with_states(self.spark)
        queries, c = [], self.config
        gap = micros(duration(c.window))
        readers = self.streams()

        def run(df: DataFrame, name: str, folder: str) -> None:
            queries.append(self._start(df, name, folder, once))
            if once:
                queries[-1].awaitTermination()

        for name, events in readers:
            run(counters.observed_events(events, name), name, f"events/{name}")
        # a reader's folder is there once its first batch has been written; the pattern takes all of them
        self.spark.createDataFrame([], readers[0][1].schema).write.mode("append").parquet(f"{self.state}/events/none")
        events = self.spark.readStream.schema(readers[0][1].schema).parquet(f"{self.state}/events/*")
        contents = sessions.contents_stream(events, gap=gap, late=self.late)
        run(contents, "contents", "contents")
        pack = rules.enabled(self.pack, c.profiles) if c.profiles else self.pack
        windows = freezes(c, *self.span) if c.freeze and self.span else []
        found = sessions.alerts_stream(self._again(contents, "contents"), pack, thresholds=(c.info, c.alert, c.high), cadence=micros(duration(c.cadence)), gap=gap, freezes=windows)
        run(counters.observed_alerts(found), "alerts", "alerts")
        if self.deliver:
            w = self._again(found, "alerts").writeStream.foreachBatch(self.deliver).option("checkpointLocation", f"{self.state}/checkpoints/delivery").queryName("delivery")
            queries.append((w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start())
            if once:
                queries[-1].awaitTermination()
        return queries


def events_read(spark: SparkSession, state: str) -> DataFrame:
    """All events that a service has read so far."""
    return spark.read.parquet(f"{state}/events/*").select(*_EVENT, "seq")
