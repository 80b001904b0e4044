"""Queries that run the streaming operators over what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.operators.score import rank
from tallyhound.plans.base import EV, SESSIONS, policy_walk, query
from tallyhound.sources.tables import stored
from tallyhound.streaming import live


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream. A row far ahead in time makes the watermark pass the end of all sessions."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.to_timestamp(F.col("ts")).alias("ts"), "event_type", "event_id")
    end = spark.createDataFrame([(-1, "end", -1)], "user_id long, event_type string, event_id long").select("user_id", F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"), "event_type", "event_id")
    path = stored(e.unionByName(end), "stream-input").inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(e.schema).parquet(path)


def _shared(df: DataFrame, name: str) -> str:
    return stored(df, name).inputFiles()[0].rsplit("/", 1)[0]


@query(SESSIONS + " SELECT user_id, count(DISTINCT session_start) AS sessions, count(*) AS events FROM ss GROUP BY user_id")
def stream_session_counts(spark: SparkSession, d: str) -> DataFrame:
    root = _shared(spark.range(1), "stream-output")
    live.run_once(live.session_counts(_stream(spark, d), gap="24 hours"), root + "/out", root + "/checkpoint")
    found = spark.read.schema("user_id long, session_start timestamp, session_end timestamp, events long").parquet(root + "/out").filter("user_id >= 0")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


DAY_US = 24 * 3_600_000_000
#: Freezes: the first six hours of every tenth day since 1970 around the events' time; as many in any year.
FREEZES = [("tenth", d * DAY_US, d * DAY_US + DAY_US // 4) for d in range(18_000, 22_000, 10)]
STREAM_SQL = EV + f""", r AS (SELECT user_id, us, seq, event_type = 'signup' AS declared, CASE WHEN seq % 100 >= 90 THEN 3 WHEN seq % 100 >= 70 THEN 2 WHEN seq % 100 >= 40 THEN 1 ELSE 0 END AS rank FROM ev),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, rank, seq) AS i,
  CASE WHEN (us // {DAY_US}) % 10 = 0 AND us % {DAY_US} < {DAY_US // 4} THEN 'tenth' ELSE '' END AS win, (us // {DAY_US}) * {DAY_US} + {DAY_US // 4} AS until FROM r), """ + policy_walk("w", "user_id", DAY_US) + """
SELECT user_id, us, event, level AS rank FROM walk WHERE event IS NOT NULL
UNION ALL SELECT user_id, max(us), 'agent_ended', max(top) FROM walk GROUP BY user_id HAVING max(top) >= 2"""


@query(STREAM_SQL)
def stream_policy(spark: SparkSession, d: str) -> DataFrame:
    root = _shared(spark.range(1), "stream-output")
    e = _stream(spark, d)
    level = F.when(F.col("user_id") >= 0, rank(F.col("event_id") % 100, 40, 70, 90)).otherwise(0)
    verdicts = e.select("user_id", "ts", F.unix_micros("ts").alias("us"), level.cast("int").alias("rank"), (F.col("event_type") == "signup").alias("declared"))
    live.run_once(live.policy_stream(verdicts, key="user_id", cadence=DAY_US, freezes=FREEZES), root + "/out", root + "/checkpoint")
    return spark.read.schema("user_id long, us long, event string, rank int").parquet(root + "/out").filter("user_id >= 0")
