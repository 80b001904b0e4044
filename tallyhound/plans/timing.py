"""Queries over the event stream: counts, sessions, timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.operators import rhythm
from tallyhound.operators.sessions import DAY, micros, session_id, sessionised, sessionised_split
from tallyhound.plans.base import EV, HOUR, KEPT, SESSIONS, event_stream, in_sessions, query, table

SESSION = ["user_id", "session_start"]


@query(EV + " SELECT kind, count(*) AS events FROM ev GROUP BY kind")
def events_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return event_stream(spark, d).groupBy("kind").agg(F.count("*").alias("events"))


@query(EV + " SELECT event_type AS source, max(us) AS last_us FROM ev GROUP BY event_type")
def last_event_by_source(spark: SparkSession, d: str) -> DataFrame:
    return event_stream(spark, d).groupBy(F.col("event_type").alias("source")).agg(F.max("us").alias("last_us"))


@query(EV + " SELECT seq, user_id, kind FROM ev WHERE kind IN ('net.conn', 'proc.seen', 'ssh.env', 'ssh.banner')")
def strong_events(spark: SparkSession, d: str) -> DataFrame:
    return event_stream(spark, d).filter(F.col("kind").isin("net.conn", "proc.seen", "ssh.env", "ssh.banner")).select("seq", "user_id", "kind")


@query(SESSIONS + " SELECT user_id, session_start, max(us) AS session_end, count(*) AS events FROM ss GROUP BY ALL")
def session_window_gap(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "24 hours").alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return w.select("user_id", micros(F.col("w.start").cast("timestamp_ntz")).alias("session_start"), micros("last").alias("session_end"), "events")


@query(SESSIONS + " SELECT user_id, seq, session_start FROM ss")
def session_of_event_split(spark: SparkSession, d: str) -> DataFrame:
    return sessionised_split(event_stream(spark, d), key=["user_id"], gap=DAY).select("user_id", "seq", "session_start")


@query(SESSIONS + " SELECT DISTINCT user_id, session_start, 'tr_' || substr(sha256(user_id::VARCHAR || chr(0) || '-' || chr(0) || 'local' || chr(0) || (session_start // 1000000)::VARCHAR), 1, 12) AS session_id FROM ss")
def session_ids(spark: SparkSession, d: str) -> DataFrame:
    s = in_sessions(spark, d).select("user_id", "session_start").distinct()
    return s.withColumn("session_id", session_id(F.col("user_id"), F.lit("-"), F.lit("local"), F.floor(F.col("session_start") / 1_000_000)))


@query(SESSIONS.replace("FROM ev)", "FROM ev WHERE kind <> 'ssh.auth_fail')") + " SELECT user_id, session_start, count(*) AS events FROM ss GROUP BY ALL")
def session_exclude_fail(spark: SparkSession, d: str) -> DataFrame:
    s = sessionised(event_stream(spark, d).filter("kind <> 'ssh.auth_fail'"), key=["user_id"], gap=DAY)
    return s.groupBy(*SESSION).agg(F.count("*").alias("events"))


@query(EV + " SELECT user_id, seq, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) AS gap_us FROM ev")
def gap_lag(spark: SparkSession, d: str) -> DataFrame:
    return event_stream(spark, d).select("user_id", "seq", (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "seq"))).alias("gap_us"))


@query(SESSIONS + f", p AS (SELECT user_id, session_start, count(*) OVER (PARTITION BY user_id, session_start ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS c FROM ss) SELECT user_id, session_start, max(c) AS peak FROM p GROUP BY ALL")
def peak_in_span(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.peaks(in_sessions(spark, d), key=SESSION, span=6 * HOUR)


@query(SESSIONS + f", g2 AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id, session_start ORDER BY us, seq) AS gap FROM ss) SELECT user_id, session_start, CAST(coalesce(floor(quantile_cont(gap, 0.5) FILTER (gap <= {DAY})), 0) AS BIGINT) AS median_gap FROM g2 GROUP BY ALL")
def median_gap(spark: SparkSession, d: str) -> DataFrame:
    per = in_sessions(spark, d).groupBy(*SESSION).agg(F.sort_array(F.collect_list("us")).alias("t"))
    return per.select(*SESSION, rhythm.median(F.filter(rhythm.gaps(F.col("t")), lambda g: g <= DAY)).alias("median_gap"))


@query(SESSIONS + ", g2 AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id, session_start ORDER BY us, seq) AS gap FROM ss) SELECT user_id, session_start, round(CASE WHEN count(gap) >= 2 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 6) AS cv FROM g2 GROUP BY ALL")
def gap_cv(spark: SparkSession, d: str) -> DataFrame:
    s = in_sessions(spark, d).withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy(*SESSION).orderBy("us", "seq")))
    return s.groupBy(*SESSION).agg(F.round(F.when((F.count("gap") >= 2) & (F.avg("gap") > 0), F.stddev_pop("gap") / F.avg("gap")), 6).alias("cv"))


@query(KEPT + " SELECT user_id, session_start, count(*) AS n FROM kept GROUP BY ALL")
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    per = in_sessions(spark, d).groupBy(*SESSION).agg(F.sort_array(F.collect_list("us")).alias("t"))
    return per.select(*SESSION, F.size(rhythm.deduped(F.col("t"), HOUR)).cast("long").alias("n"))


def session_features(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.features(in_sessions(spark, d), key=SESSION, dedupe=HOUR, span=6 * HOUR, cut=DAY)


#: Thresholds scaled to the sparse test events.
SCALED = {"burst": 3, "regular": 0.8, "quick": 3 * HOUR, "sustained": 15}
CLUES_SQL = KEPT + f""",
clues AS (SELECT user_id, session_start, unnest([{{'clue': 'rhythm.burst', 'weight': CASE WHEN n >= 4 AND peak >= 3 THEN 20 ELSE 0 END}},
  {{'clue': 'rhythm.regular', 'weight': CASE WHEN n >= 6 AND cv < 0.8 THEN 10 ELSE 0 END}}, {{'clue': 'rhythm.subsecond', 'weight': CASE WHEN n >= 4 AND median_gap > 0 AND median_gap < {3 * HOUR} THEN 10 ELSE 0 END}},
  {{'clue': 'rhythm.sustained', 'weight': CASE WHEN n >= 15 THEN 10 ELSE 0 END}}], recursive := true) FROM feats)"""


def long_clues(features: DataFrame) -> DataFrame:
    clues = rhythm.rhythm_clues(F.col("n"), F.col("peak"), F.col("median_gap"), F.col("cv"), **SCALED)
    return features.select(*SESSION, F.explode(F.array(*[F.struct(F.lit(k).alias("clue"), v.alias("weight")) for k, v in clues.items()])).alias("c")).select(*SESSION, "c.clue", "c.weight").filter("weight > 0")


@query(CLUES_SQL + " SELECT user_id, session_start, clue, weight FROM clues WHERE weight > 0")
def rhythm_clues(spark: SparkSession, d: str) -> DataFrame:
    return long_clues(session_features(spark, d))


@query(SESSIONS + f""", g2 AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id, session_start ORDER BY us, seq) AS gap FROM ss WHERE kind <> 'net.conn'),
f AS (SELECT user_id, session_start, count(*) AS n, coalesce(floor(quantile_cont(gap, 0.5) FILTER (gap <= {DAY})), 0) AS m, stddev_pop(gap) / avg(gap) AS cv FROM g2 GROUP BY ALL)
SELECT user_id, session_start FROM f WHERE n >= 8 AND m BETWEEN {HOUR} AND {12 * HOUR} AND cv >= 0.5""")
def think_time_clue(spark: SparkSession, d: str) -> DataFrame:
    per = in_sessions(spark, d).filter("kind <> 'net.conn'").groupBy(*SESSION).agg(F.sort_array(F.collect_list("us")).alias("t")).withColumn("g", rhythm.gaps(F.col("t")))
    clue = rhythm.think_time(F.size("t"), rhythm.median(F.filter("g", lambda g: g <= DAY)), rhythm.variation(F.col("g")), low=HOUR, high=12 * HOUR)
    return per.filter(clue > 0).select(*SESSION)


@query(SESSIONS + f""", n AS (SELECT *, lead(us) OVER (PARTITION BY user_id, session_start ORDER BY us, seq) AS next_us FROM ss)
SELECT user_id, session_start, max(coalesce(next_us, us) - us) AS longest_us, max(coalesce(next_us, us) - us) > {6 * HOUR} AS interactive FROM n WHERE event_type = 'signup' GROUP BY ALL""")
def pty_like_clues(spark: SparkSession, d: str) -> DataFrame:
    s = in_sessions(spark, d).withColumn("next_us", F.lead("us").over(Window.partitionBy(*SESSION).orderBy("us", "seq"))).filter("event_type = 'signup'")
    longest = F.max(F.coalesce("next_us", "us") - F.col("us"))
    return s.groupBy(*SESSION).agg(longest.alias("longest_us"), (longest > 6 * HOUR).alias("interactive"))


@query(SESSIONS + ", a AS (SELECT user_id, session_start, count(*) AS activity FROM ss GROUP BY ALL) SELECT user_id, session_start, activity FROM a ORDER BY activity DESC, session_start, user_id LIMIT 1")
def busiest_session(spark: SparkSession, d: str) -> DataFrame:
    return in_sessions(spark, d).groupBy(*SESSION).agg(F.count("*").alias("activity")).orderBy(F.desc("activity"), "session_start", "user_id").limit(1)


@query(SESSIONS + " SELECT user_id, session_start, count(*) FILTER (event_type = 'click') AS exec_channels, count(*) FILTER (event_type = 'signup') AS shells, sum(k) FILTER (event_type = 'view') AS forced, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM ss GROUP BY ALL")
def connection_counters(spark: SparkSession, d: str) -> DataFrame:
    return in_sessions(spark, d).groupBy(*SESSION).agg(
        F.count_if(F.col("event_type") == "click").alias("exec_channels"), F.count_if(F.col("event_type") == "signup").alias("shells"), F.sum(F.when(F.col("event_type") == "view", F.col("k"))).alias("forced"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
    )


@query(SESSIONS + ", f AS (SELECT user_id, session_start, event_type, min((us, seq)) AS seen_at FROM ss GROUP BY ALL) SELECT user_id, session_start, string_agg(event_type, ',' ORDER BY seen_at) AS kinds FROM f GROUP BY ALL")
def distinct_in_first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "event_type"))), lambda x: x["event_type"])
    return in_sessions(spark, d).groupBy(*SESSION).agg(F.array_join(F.array_distinct(ordered), ",").alias("kinds"))


@query(SESSIONS + f", m AS (SELECT *, max(us) OVER (PARTITION BY user_id, session_start) AS now FROM ss) SELECT user_id, session_start, count(*) AS recent FROM m WHERE us >= now - {6 * HOUR} GROUP BY ALL")
def trimmed_content(spark: SparkSession, d: str) -> DataFrame:
    s = in_sessions(spark, d).withColumn("now", F.max("us").over(Window.partitionBy(*SESSION)))
    return s.filter(F.col("us") >= F.col("now") - 6 * HOUR).groupBy(*SESSION).agg(F.count("*").alias("recent"))


@query(SESSIONS + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_start ORDER BY us DESC, seq DESC) AS r FROM ss) SELECT user_id, session_start, seq FROM r WHERE r <= 20")
def newest_commands_kept(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy(*SESSION).orderBy(F.desc("us"), F.desc("seq"))
    return in_sessions(spark, d).withColumn("r", F.row_number().over(order)).filter("r <= 20").select(*SESSION, "seq")


@query(SESSIONS + f""", e AS (SELECT user_id, session_start, max(us) + {DAY} AS ends_us, count(*) AS events, bool_or(event_type = 'purchase') AS bought FROM ss GROUP BY ALL), now AS (SELECT max(us) AS now FROM ev)
SELECT user_id, session_start, ends_us FROM e, now WHERE ends_us < now AND bought""")
def ended_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = in_sessions(spark, d)
    ends = s.groupBy(*SESSION).agg((F.max("us") + DAY).alias("ends_us"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return ends.join(F.broadcast(s.agg(F.max("us").alias("now"))), F.col("ends_us") < F.col("now")).filter("bought").select(*SESSION, "ends_us")
