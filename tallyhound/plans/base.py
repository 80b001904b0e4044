"""The register of queries, and the event stream they read.

The test tables hold no log-ins. Their events stand in for them: sign-ups for log-ins, errors for failed ones, clicks
for sessions, views for commands, purchases for connections; times are microseconds and event_id breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.operators.sessions import DAY, micros, sessionised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOUR = DAY // 24
KINDS = {"signup": "ssh.auth_ok", "error": "ssh.auth_fail", "click": "ssh.session_start", "view": "audit.execve", "purchase": "net.conn"}

EV = "ev AS (SELECT event_id AS seq, user_id, epoch_us(ts) AS us, event_type, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
SESSIONS = EV + f""",
gapped AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) <= {DAY} THEN 0 ELSE 1 END AS opens FROM ev),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, seq) AS number FROM gapped),
ss AS (SELECT *, min(us) OVER (PARTITION BY user_id, number) AS session_start FROM numbered)"""
#: Deduplicated times of each session, by a recursive walk from each kept time to the next one at least an hour later.
KEPT = SESSIONS + f""",
kept(user_id, session_start, us) AS (
  SELECT DISTINCT user_id, session_start, session_start FROM ss
  UNION ALL
  SELECT k.user_id, k.session_start, (SELECT min(s.us) FROM ss s WHERE s.user_id = k.user_id AND s.session_start = k.session_start AND s.us >= k.us + {HOUR}) FROM kept k
  WHERE EXISTS (SELECT 1 FROM ss s WHERE s.user_id = k.user_id AND s.session_start = k.session_start AND s.us >= k.us + {HOUR})),
steps AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id, session_start ORDER BY us) AS gap, count(*) OVER (PARTITION BY user_id, session_start ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS near FROM kept),
feats AS (SELECT user_id, session_start, count(*) AS n, max(near) AS peak, CAST(coalesce(floor(quantile_cont(gap, 0.5) FILTER (gap <= {DAY})), 0) AS BIGINT) AS median_gap,
  CASE WHEN count(gap) < 2 OR avg(gap) <= 0 THEN NULL ELSE stddev_pop(gap) / avg(gap) END AS cv FROM steps GROUP BY ALL)"""


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            head, _, rest = sql.strip().partition(" ")
            ORACLE[f.__name__] = f"WITH RECURSIVE {sql.strip()}" if head == "ev" or head.endswith("AS") else sql.strip()
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), "user_id", micros("ts").alias("us"), "event_type", F.element_at(kinds, F.col("event_type")).alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def in_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionised(event_stream(spark, d), key=["user_id"], gap=DAY)


def policy_walk(verdicts: str, key: str, cadence: int) -> str:
    """The alert policy as a recursive walk over a CTE (key, i from 1 within the key, us, seq, rank, declared, win, until): CTE `walk`, a row for each verdict, event null where nothing is told."""
    return f"""walk AS (
  SELECT {key}, 0::BIGINT AS i, 0::BIGINT AS us, 0::BIGINT AS seq, NULL::VARCHAR AS event, 0 AS level, 0 AS top, false AS said, NULL::BIGINT AS last, NULL::BIGINT AS frozen, 0 AS seen FROM {verdicts} WHERE i = 1
  UNION ALL
  SELECT {key}, i, us, seq, event, level, CASE WHEN event IS NULL THEN top ELSE greatest(top, level) END, said OR coalesce(event = 'agent_declared', false), CASE WHEN event IS NULL THEN last ELSE us END,
    CASE WHEN held THEN until ELSE frozen END, CASE WHEN held AND event IS NOT NULL THEN CASE WHEN fresh THEN rank ELSE greatest(seen, rank) END ELSE seen END
  FROM (SELECT *, CASE event WHEN 'freeze_violation' THEN 3 WHEN 'agent_declared' THEN 1 ELSE rank END AS level FROM (SELECT *,
    CASE WHEN held AND fresh THEN 'freeze_violation' WHEN held AND rank >= 2 AND rank > seen THEN high WHEN held AND due THEN 'agent_still_active' WHEN held THEN NULL
      WHEN declared AND NOT said THEN 'agent_declared' WHEN rank < 1 OR (declared AND rank < 2) THEN NULL
      WHEN rank > top THEN CASE WHEN rank = 1 THEN 'info' ELSE high END WHEN rank >= 2 AND due THEN 'agent_still_active' END AS event
    FROM (SELECT v.*, top, said, last, frozen, seen, win <> '' AND (declared OR rank >= 1) AS held, frozen IS DISTINCT FROM until AS fresh, last IS NULL OR v.us - last >= {cadence} AS due,
        CASE WHEN rank >= 3 THEN 'agent_high' ELSE 'agent_detected' END AS high
      FROM (SELECT {key}, i AS _i, top, said, last, frozen, seen FROM walk) w JOIN {verdicts} v USING ({key}) WHERE v.i = w._i + 1))))"""
