"""The report over alerts: totals, groups, clues, timeline; and the repetition rules of alert consoles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.operators.sessions import folded
from tallyhound.plans.base import HOUR, SESSIONS, in_sessions, query
from tallyhound.plans.verdict import RANKED_SQL, ranked_events

ALERTS_SQL = RANKED_SQL + """, firsts AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY user_id, session_start ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM vv),
alerts AS (SELECT user_id || '-' || session_start AS session_id, user_id, us, seq, rank, 25 * rank + seq % 7 AS score, 'host' || user_id % 5 AS host, CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '?guess' ELSE 'agent' || user_id % 4 END AS agent,
  CASE WHEN event_type = 'signup' THEN 'declared_agent' WHEN rank >= 2 THEN 'suspected_agent' ELSE 'human' END AS class, CASE WHEN rank = 3 THEN 'agent_high' WHEN rank = 2 THEN 'agent_detected' ELSE 'info' END AS event, (us // 3600000000) % 24 < 2 AS in_freeze, event_type FROM firsts WHERE rank > prev)"""
FOLD_SQL = ALERTS_SQL + """, fold AS (SELECT session_id, any_value(user_id) AS user_id, any_value(host) AS host, count(*) AS alerts, min(us) AS first_us, max(us) AS last_us, arg_max(event, (us, seq)) AS last_event, max(score) AS max_score, max(rank) AS max_rank,
  CASE WHEN bool_or(class = 'declared_agent') THEN 'declared_agent' WHEN bool_or(class = 'suspected_agent') THEN 'suspected_agent' ELSE arg_min(class, (us, seq)) END AS class,
  coalesce(arg_max(agent, (us, seq)) FILTER (agent <> '' AND agent NOT LIKE '?%'), arg_min(agent, (us, seq)) FILTER (agent <> ''), '') AS agent, bool_or(in_freeze) AS in_freeze FROM alerts GROUP BY session_id)"""


def alert_rows(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("user_id", "session_start").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    v = ranked_events(spark, d).withColumn("prev", F.coalesce(F.max("rank").over(before), F.lit(0))).filter("rank > prev")
    u = F.col("user_id")
    return v.select(
        F.concat_ws("-", "user_id", "session_start").alias("session_id"), "user_id", "us", "seq", "rank", (25 * F.col("rank") + F.col("seq") % 7).alias("score"), F.concat(F.lit("host"), (u % 5).cast("string")).alias("host"),
        F.when(u % 3 == 0, "").when(u % 3 == 1, "?guess").otherwise(F.concat(F.lit("agent"), (u % 4).cast("string"))).alias("agent"),
        F.when(F.col("event_type") == "signup", "declared_agent").when(F.col("rank") >= 2, "suspected_agent").otherwise("human").alias("class"),
        F.when(F.col("rank") == 3, "agent_high").when(F.col("rank") == 2, "agent_detected").otherwise("info").alias("event"), (F.expr("us div 3600000000") % 24 < 2).alias("in_freeze"), "event_type",
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = alert_rows(spark, d)
    same = rows.groupBy("session_id").agg(F.first("user_id").alias("user_id"), F.first("host").alias("host"))
    return folded(rows).join(same, "session_id")


@query(FOLD_SQL + " SELECT session_id, alerts, first_us, last_us, last_event, max_score, max_rank, class, agent, in_freeze FROM fold")
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    return folded(alert_rows(spark, d))


def top_by(found: DataFrame, dim: Column, limit: int = 0) -> DataFrame:
    """Sessions, declared, suspected, mean and highest score by a dimension, the largest groups first; limit 0 is all."""
    out = found.groupBy(dim.cast("string").alias("grp")).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("class") == "declared_agent").alias("declared"), F.count_if(F.col("class") == "suspected_agent").alias("suspected"), F.round(F.avg("max_score"), 1).alias("mean_score"), F.max("max_score").alias("max_score")
    ).orderBy(F.desc("sessions"), F.desc("max_score"), "grp")
    return out.limit(limit) if limit else out


def _top_sql(dim: str, limit: int) -> str:
    return FOLD_SQL + f" SELECT ({dim})::VARCHAR AS grp, count(*) AS sessions, count(*) FILTER (class = 'declared_agent') AS declared, count(*) FILTER (class = 'suspected_agent') AS suspected, round(avg(max_score), 1) AS mean_score, max(max_score) AS max_score FROM fold GROUP BY 1 ORDER BY sessions DESC, max_score DESC, grp" + (f" LIMIT {limit}" if limit else "")


@query(_top_sql("user_id", 10))
def top_by_account(spark: SparkSession, d: str) -> DataFrame:
    return top_by(sessions(spark, d), F.col("user_id"), 10)


@query(_top_sql("host", 3))
def top_by_server(spark: SparkSession, d: str) -> DataFrame:
    return top_by(sessions(spark, d), F.col("host"), 3)


@query(_top_sql("CASE WHEN agent = '' THEN 'unknown' ELSE agent END", 0))
def top_by_agent(spark: SparkSession, d: str) -> DataFrame:
    return top_by(sessions(spark, d), F.when(F.col("agent") == "", "unknown").otherwise(F.col("agent")))


@query(_top_sql("user_id % 11", 5))
def top_by_key(spark: SparkSession, d: str) -> DataFrame:
    return top_by(sessions(spark, d), F.col("user_id") % 11, 5)


@query(ALERTS_SQL + " SELECT event_type AS clue, count(DISTINCT session_id) AS sessions FROM alerts GROUP BY 1 ORDER BY sessions DESC, clue LIMIT 5")
def top_clues(spark: SparkSession, d: str) -> DataFrame:
    pairs = alert_rows(spark, d).select("session_id", F.col("event_type").alias("clue")).distinct()
    return pairs.groupBy("clue").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "clue").limit(5)


@query(FOLD_SQL + " SELECT sum(alerts)::BIGINT AS alerts, count(*) AS sessions, count(*) FILTER (class = 'declared_agent') AS declared, count(*) FILTER (class = 'suspected_agent') AS suspected, count(*) FILTER (class = 'human') AS human, count(*) FILTER (max_rank = 3) AS high, count(*) FILTER (in_freeze) AS freezes FROM fold")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    c = lambda value: F.count_if(F.col("class") == value)
    return folded(alert_rows(spark, d)).agg(F.sum("alerts").alias("alerts"), F.count("*").alias("sessions"), c("declared_agent").alias("declared"), c("suspected_agent").alias("suspected"), c("human").alias("human"), F.count_if(F.col("max_rank") == 3).alias("high"), F.count_if("in_freeze").alias("freezes"))


@query(ALERTS_SQL + " SELECT class, rank, count(*) AS alerts FROM alerts GROUP BY GROUPING SETS ((class), (rank), ())")
def alerts_by_class_and_level(spark: SparkSession, d: str) -> DataFrame:
    rows = alert_rows(spark, d)
    return rows.groupingSets([["class"], ["rank"], []], "class", "rank").agg(F.count("*").alias("alerts"))


@query(ALERTS_SQL + " SELECT us, seq, event, rank FROM alerts WHERE user_id = 7 AND rank >= 2 ORDER BY us, seq")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return alert_rows(spark, d).filter("user_id = 7 AND rank >= 2").select("us", "seq", "event", "rank").orderBy("us", "seq")


@query(SESSIONS + f", c AS (SELECT user_id, us, seq, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS n FROM ss) SELECT user_id, seq, n FROM c WHERE n >= 3")
def repeat_alerts_1h(spark: SparkSession, d: str) -> DataFrame:
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-HOUR, 0)
    return in_sessions(spark, d).withColumn("n", F.count("*").over(hour)).filter("n >= 3").select("user_id", "seq", "n")


@query(SESSIONS + f", c AS (SELECT a.user_id, a.seq, count(DISTINCT b.k % 5) AS hosts FROM ss a JOIN ss b ON a.user_id = b.user_id AND b.us BETWEEN a.us - {HOUR} AND a.us GROUP BY ALL) SELECT user_id, seq, hosts FROM c WHERE hosts >= 2")
def multi_host_1h(spark: SparkSession, d: str) -> DataFrame:
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-HOUR, 0)
    seen = F.size(F.collect_set(F.col("k") % 5).over(hour)).cast("long")
    return in_sessions(spark, d).withColumn("hosts", seen).filter("hosts >= 2").select("user_id", "seq", "hosts")


@query(SESSIONS + " SELECT k % 16 AS ip, count(*) AS failures FROM ss WHERE event_type = 'error' GROUP BY 1")
def fail_counts_by_ip(spark: SparkSession, d: str) -> DataFrame:
    return in_sessions(spark, d).filter("event_type = 'error'").groupBy((F.col("k") % 16).alias("ip")).agg(F.count("*").alias("failures"))
