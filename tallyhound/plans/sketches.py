"""Failures by address and hosts by account, by sketches; the values are few, so that they are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.operators import sketches
from tallyhound.plans.base import EV, event_stream, query


@query(EV + " SELECT k % 16 AS ip, count(*) AS failures FROM ev WHERE event_type = 'error' AND k IS NOT NULL GROUP BY 1")
def failures_by_sketch(spark: SparkSession, d: str) -> DataFrame:
    failed = event_stream(spark, d).filter("event_type = 'error'").select((F.col("k") % 16).alias("ip"), (F.col("user_id") % 5).alias("server"))
    daily = sketches.frequencies(failed, "ip", "server", tracked=64)  # one sketch a server, merged afterwards
    return sketches.heaviest(daily, 16, tracked=64).select(F.col("item").alias("ip"), F.col("count").alias("failures"))


HOPS_SQL = EV + """, h AS (SELECT user_id, k % 5 AS host, us, unnest(range((us // 21600000000) * 21600000000 - 64800000000, us + 1, 21600000000)) AS start FROM ev)
SELECT user_id, start, count(DISTINCT host) AS hosts, count(*) AS n FROM h GROUP BY user_id, start HAVING count(DISTINCT host) >= 2"""


@query(HOPS_SQL)
def multi_host_hops(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d).select("user_id", (F.col("k") % 5).alias("host"), F.timestamp_micros("us").alias("ts"))
    found = sketches.on_many(sketches.distinct_in_hops(e, key="user_id", what="host", span="24 hours", hop="6 hours"))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.col("distinct").alias("hosts"), "n")
