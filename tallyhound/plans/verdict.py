"""Queries that score sessions and decide on alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.operators import policy, score
from tallyhound.plans.base import HOUR, SESSIONS, in_sessions, query, policy_walk
from tallyhound.plans.timing import CLUES_SQL, SESSION, long_clues, session_features

KINDS_SQL = ", kinds AS (SELECT user_id, session_start, count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS signups FROM ss GROUP BY ALL)"
POINTS_SQL = CLUES_SQL + KINDS_SQL + """,
rhythm AS (SELECT user_id, session_start, sum(weight) AS r FROM clues GROUP BY ALL),
points AS (SELECT user_id, session_start, least(45, r) AS rhythm, least(30, 15 * buys) AS network, least(30, 8 * errors) AS style, signups FROM rhythm JOIN kinds USING (user_id, session_start)),
scored AS (SELECT *, greatest(0, least(100, rhythm + network + style - CASE WHEN signups >= 3 THEN 15 ELSE 0 END))::INTEGER AS score, (rhythm > 0)::INT + (network > 0)::INT + (style > 0)::INT AS categories FROM points),
ranked AS (SELECT *, CASE WHEN score >= 60 THEN 3 WHEN score >= 30 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END AS first_rank FROM scored),
judged AS (SELECT *, CASE WHEN first_rank >= 2 AND categories < 2 THEN 1 ELSE first_rank END AS rank FROM ranked)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    clues = long_clues(session_features(spark, d)).groupBy(*SESSION).agg(F.sum("weight").alias("r"))
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    kinds = in_sessions(spark, d).groupBy(*SESSION).agg(count("purchase").alias("buys"), count("error").alias("errors"), count("signup").alias("signups"))
    both = kinds.join(clues, SESSION, "left").fillna(0, ["r"])
    p = {"rhythm": F.col("r"), "network": 15 * F.col("buys"), "style": 8 * F.col("errors")}
    both = both.withColumns({c: F.least(x, F.lit(score.CAPS[c])) for c, x in p.items()})
    total = score.clamped(score.capped({c: F.col(c) for c in p}) - F.when(F.col("signups") >= 3, 15).otherwise(0))
    held = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in p), F.lit(0))
    return both.withColumn("score", total.cast("int")).withColumn("categories", held)


def judged(spark: SparkSession, d: str) -> DataFrame:
    first = score.rank(F.col("score"), 20, 30, 60)
    return points(spark, d).withColumn("first_rank", first).withColumn("rank", score.downgraded(F.col("first_rank"), F.col("categories")))


@query(POINTS_SQL + " SELECT user_id, session_start, score, categories FROM scored")
def additive_capped_score(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select(*SESSION, "score", "categories")


@query(POINTS_SQL + " SELECT user_id, session_start, score, CASE rank WHEN 3 THEN 'high' WHEN 2 THEN 'alert' WHEN 1 THEN 'info' ELSE 'none' END AS level, CASE WHEN rank >= 2 THEN 'suspected_agent' ELSE 'human' END AS class FROM judged")
def verdict_level_class(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return j.select(*SESSION, "score", score.level(F.col("rank")).alias("level"), F.when(F.col("rank") >= 2, "suspected_agent").otherwise("human").alias("class"))


@query(POINTS_SQL + " SELECT user_id, session_start, first_rank, rank FROM judged WHERE first_rank <> rank")
def two_category_downgrade(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).filter("first_rank <> rank").select(*SESSION, "first_rank", "rank")


RANKED_SQL = SESSIONS + """, vv AS (SELECT user_id, session_start, us, seq, CASE WHEN run >= 12 THEN 3 WHEN run >= 6 THEN 2 WHEN run >= 3 THEN 1 ELSE 0 END AS rank, event_type FROM
  (SELECT *, count(*) OVER (PARTITION BY user_id, session_start ORDER BY us, seq) AS run FROM ss))"""


def ranked_events(spark: SparkSession, d: str) -> DataFrame:
    """A verdict for each event: a session's level rises with its events."""
    run = F.count("*").over(Window.partitionBy(*SESSION).orderBy("us", "seq"))
    return in_sessions(spark, d).withColumn("rank", score.rank(run, 3, 6, 12))


@query(RANKED_SQL + ", p AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY user_id, session_start ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM vv) SELECT user_id, session_start, seq, rank, prev FROM p WHERE rank > prev")
def level_crossings(spark: SparkSession, d: str) -> DataFrame:
    return policy.crossings(ranked_events(spark, d), key=SESSION).select(*SESSION, "seq", "rank", "prev")


CADENCE_SQL = RANKED_SQL + f""", hi AS (SELECT * FROM vv WHERE rank >= 2),
said(user_id, session_start, us) AS (SELECT user_id, session_start, min(us) FROM hi GROUP BY ALL
  UNION ALL SELECT s.user_id, s.session_start, (SELECT min(h.us) FROM hi h WHERE h.user_id = s.user_id AND h.session_start = s.session_start AND h.us >= s.us + {12 * HOUR}) FROM said s
  WHERE EXISTS (SELECT 1 FROM hi h WHERE h.user_id = s.user_id AND h.session_start = s.session_start AND h.us >= s.us + {12 * HOUR}))"""


@query(CADENCE_SQL + " SELECT user_id, session_start, us FROM said")
def realert_cadence(spark: SparkSession, d: str) -> DataFrame:
    per = ranked_events(spark, d).filter("rank >= 2").groupBy(*SESSION).agg(F.sort_array(F.collect_list("us")).alias("t"))
    return per.select(*SESSION, F.explode(policy.reminded(F.col("t"), 12 * HOUR)).alias("us"))


@query(SESSIONS + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_start ORDER BY us, seq) AS r FROM ss WHERE event_type = 'signup') SELECT user_id, session_start, seq, us FROM r WHERE r = 1")
def declared_once(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.struct("us", "seq"))
    return in_sessions(spark, d).filter("event_type = 'signup'").groupBy(*SESSION).agg(first.alias("f")).select(*SESSION, "f.seq", "f.us")


POLICY_SQL = RANKED_SQL + f""", w AS (SELECT user_id, session_start, row_number() OVER o AS i, us, seq, rank, bool_or(event_type = 'signup') OVER o AS declared,
  CASE WHEN (us // {HOUR}) % 24 < 2 THEN 'night' ELSE '' END AS win, ((us // {24 * HOUR}) * 24 + 2) * {HOUR} AS until FROM vv WINDOW o AS (PARTITION BY user_id, session_start ORDER BY us, seq)), """ + policy_walk("w", "user_id, session_start", 12 * HOUR)


@query(POLICY_SQL + " SELECT user_id, session_start, us, seq, event, level AS rank FROM walk WHERE event IS NOT NULL")
def policy_alerts(spark: SparkSession, d: str) -> DataFrame:
    v = ranked_events(spark, d)
    declared = F.max(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(Window.partitionBy(*SESSION).orderBy("us", "seq")) == 1
    night = F.pmod(F.floor(F.col("us") / HOUR), F.lit(24)) < 2
    until = ((F.floor(F.col("us") / (24 * HOUR)) * 24 + 2) * HOUR).cast("long")
    v = v.withColumn("declared", declared).withColumn("freeze", F.when(night, "night").otherwise("")).withColumn("until", until)
    return policy.alerts(v, key=SESSION, cadence=12 * HOUR)


@query(POINTS_SQL + ", hits AS (SELECT user_id, session_start, count(*) FILTER (kind = 'audit.execve' AND k % 2 = 0) AS hit, count(*) FILTER (kind = 'audit.execve') AS texts, count(*) FILTER (kind = 'ssh.session_start') AS channels, bool_or(kind = 'net.conn') AS required FROM ss GROUP BY ALL) SELECT user_id, session_start, round(hit / greatest(1, texts, channels), 6) AS ratio, required AND hit / greatest(1, texts, channels) >= 0.4 AS matches FROM hits")
def profile_ratio(spark: SparkSession, d: str) -> DataFrame:
    texts, channels = F.count_if(F.col("kind") == "audit.execve"), F.count_if(F.col("kind") == "ssh.session_start")
    ratio = score.match_ratio(F.count_if((F.col("kind") == "audit.execve") & (F.col("k") % 2 == 0)), texts, channels)
    return in_sessions(spark, d).groupBy(*SESSION).agg(F.round(ratio, 6).alias("ratio"), (F.bool_or(F.col("kind") == "net.conn") & (ratio >= 0.4)).alias("matches"))


#: A profile that a session of an even user may match, and what it suppresses.
SUPPRESSED = ["rhythm.burst", "style", "rhythm.sub"]


@query(CLUES_SQL + " SELECT user_id, session_start, clue, user_id % 2 = 0 AND clue = 'rhythm.burst' AS suppressed FROM clues WHERE weight > 0")
def profile_suppress(spark: SparkSession, d: str) -> DataFrame:
    rules = F.array(*map(F.lit, SUPPRESSED))
    covered = F.exists(rules, lambda r: score.suppresses(r, F.col("clue"), F.lit("rhythm")))
    return long_clues(session_features(spark, d)).select(*SESSION, "clue", ((F.col("user_id") % 2 == 0) & covered).alias("suppressed"))
