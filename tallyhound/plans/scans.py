"""Scans made of the event table: each user is a process, seen on each day that it has an event, restarted every month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.operators import snapshots
from tallyhound.operators.sessions import DAY
from tallyhound.plans.base import EV, event_stream, query

SCANS_SQL = EV + f""", r AS (SELECT DISTINCT user_id % 7 AS h, us // {DAY} AS d, user_id AS pid, user_id * 1000 + (us // {DAY}) // 30 AS start FROM ev),
s AS (SELECT h, d, row_number() OVER (PARTITION BY h ORDER BY d) AS n, lead(d) OVER (PARTITION BY h ORDER BY d) AS nx FROM (SELECT DISTINCT h, d FROM r)),
l AS (SELECT *, n - row_number() OVER (PARTITION BY h, pid, start ORDER BY n) AS life FROM r JOIN s USING (h, d)),
t(h, pid, start, life, d) AS (SELECT h, pid, start, life, min(d) FROM l GROUP BY ALL
  UNION ALL SELECT t.h, t.pid, t.start, t.life, min(l.d) FROM t JOIN l USING (h, pid, start, life) WHERE l.d >= t.d + 3 GROUP BY ALL),
g AS (SELECT h, pid, arg_max(coalesce(nx, -1), d) AS d FROM l GROUP BY h, pid, start, life)
SELECT concat('h', h) AS host, 'proc.seen' AS kind, pid, d FROM t UNION ALL SELECT concat('h', h), 'proc.gone', pid, d FROM g WHERE d >= 0"""


@query(SCANS_SQL)
def scan_events(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.col("us") / DAY)
    rows = event_stream(spark, d).select(F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("host"), (day * DAY).alias("at"), F.col("user_id").alias("pid"), (F.col("user_id") * 1000 + F.floor(day / 30)).alias("start_ticks")).distinct()
    whole = rows.withColumns({"ses": F.lit(0), "user": F.lit(""), "fields": F.create_map(F.lit("comm"), F.lit("p"))})
    found = snapshots.process_events(whole, rows.select("host", "at"), refresh=3 * DAY)
    return found.select("host", "kind", F.col("pid").cast("long").alias("pid"), F.floor(F.unix_micros("ts") / DAY).alias("d"))
