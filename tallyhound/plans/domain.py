"""The whole way from log lines to verdicts as a query: readers, connections, sessions, and a verdict at each event.

The lines are made of the event table, one server line or two audit records an event, on a clock of one event every
970 milliseconds: a sign-up is a log-in, a click a command channel, a purchase a client's banner, an error a failed
log-in, and a view a command as the kernel reports it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.operators import correlate, running
from tallyhound.plans.base import query, table
from tallyhound.sources import audit_log, rules, sshd_log
from tallyhound.sources.tables import stored

BASE, STEP = 1_789_000_000_000_000, 970_000


def log_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(server lines, audit lines), one text column `value` each."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.lit(BASE) + F.col("event_id") * STEP).alias("us"))
    # a file of few row groups gives few tasks, and reading a line is work; without a number Spark would join small parts again
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    at = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    place = F.format_string("from 10.1.%d.%d port %d", F.floor(F.col("user_id") / 250) % 250, F.col("user_id") % 250, F.lit(1024) + F.col("user_id") % 60000)
    message = (
        F.when(F.col("event_type") == "signup", F.format_string("Accepted publickey for %s %s ssh2: ED25519 SHA256:k%d", user, place, "user_id"))
        .when(F.col("event_type") == "click", F.format_string("Starting session: command for %s %s id 0", user, place))
        .when(F.col("event_type") == "error", F.format_string("Failed password for %s %s ssh2", user, place))
        .when(F.col("event_type") == "purchase", F.format_string("Remote protocol version 2.0, remote software version %s", F.when(F.col("event_id") % 3 == 0, "paramiko_3.1").otherwise("OpenSSH_9.6")))
    )
    server = e.select(F.format_string("%s web sshd[%d]: %s", at, F.lit(100) + F.col("user_id"), message).alias("value"), message.isNotNull().alias("some")).filter("some").select("value")
    head = F.format_string("msg=audit(%d.%03d:%d):", F.floor(F.col("us") / 1_000_000), F.floor(F.col("us") / 1000) % 1000, "event_id")
    call = F.format_string('type=SYSCALL %s arch=c000003e syscall=59 success=yes ppid=1 pid=%d ses=4294967295 comm="sh" exe="/bin/sh"\x1dAUID="%s"', head, F.lit(100_000) + F.col("event_id") % 100_000, user)
    args = F.format_string('type=EXECVE %s argc=1 a0="%s"', head, F.when(F.col("event_id") % 2 == 0, "cat notes | head -n 5").otherwise("ls"))
    audit = e.filter("event_type = 'view'").select(F.explode(F.array(call, args)).alias("value"))
    return server, audit


VERDICTS_SQL = f"""ev AS (SELECT user_id, event_id AS id, {BASE} + event_id * {STEP} AS us, event_type AS t FROM events),
conn AS (SELECT user_id, min(us) AS opened, bool_or(t = 'signup') AS keyed FROM ev WHERE t IN ('signup', 'click', 'purchase') GROUP BY user_id HAVING bool_or(t <> 'purchase')),
kept AS (SELECT ev.*, opened, keyed FROM ev JOIN conn USING (user_id) WHERE t IN ('signup', 'click', 'purchase') OR (t = 'view' AND us >= opened)),
cut AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {correlate.WINDOW} AS opens FROM kept),
run AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY us) AS number FROM cut),
s AS (SELECT *, min(us) OVER (PARTITION BY user_id, number) AS session_start, t IN ('view', 'click') AS cmd FROM run),
g AS (SELECT *, session_start <= opened AS own, CASE WHEN cmd THEN us - max(CASE WHEN cmd THEN us END) OVER b END AS gap, CASE WHEN t = 'click' THEN us - max(CASE WHEN t = 'click' THEN us END) OVER b END AS cgap,
  CASE WHEN cmd THEN count(*) FILTER (cmd) OVER (PARTITION BY user_id, session_start ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) END AS near
  FROM s WINDOW b AS (PARTITION BY user_id, session_start ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, count(*) FILTER (cmd) OVER w AS n, count(*) FILTER (t = 'click') OVER w AS chan, max(near) OVER w AS peak, coalesce(floor(quantile_cont(gap, 0.5) FILTER (gap <= 60000000) OVER w), 0) AS mid,
  coalesce(floor(quantile_cont(cgap, 0.5) FILTER (cgap <= 60000000) OVER w), 0) AS cmid, count(gap) OVER w AS gaps, stddev_pop(gap) OVER w / avg(gap) OVER w AS cv, count(cgap) OVER w AS cgaps, stddev_pop(cgap) OVER w / avg(cgap) OVER w AS ccv,
  count(*) FILTER (t = 'click' AND own) OVER w AS execs, count(*) FILTER (t = 'view' AND id % 2 = 0) OVER w AS heads, max(CASE WHEN t = 'purchase' AND own THEN id END) OVER w AS banner
  FROM g WINDOW w AS (PARTITION BY user_id, session_start ORDER BY us ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE least(45, CASE WHEN peak >= 6 THEN 20 ELSE 0 END + CASE WHEN n >= 6 AND gaps >= 2 AND cv < 0.35 THEN 10 ELSE 0 END + CASE WHEN mid > 0 AND mid < 1500000 THEN 10 ELSE 0 END
    + CASE WHEN n >= 25 THEN 10 ELSE 0 END + CASE WHEN chan >= 8 AND cmid BETWEEN 1500000 AND 30000000 AND (cgaps < 2 OR ccv >= 0.5) THEN 15 ELSE 0 END) END AS rhythm,
  CASE WHEN execs >= 3 THEN 15 ELSE 0 END AS pty, CASE WHEN heads > 0 THEN 5 ELSE 0 END AS style, CASE WHEN banner % 3 = 0 THEN 35 ELSE 0 END AS ban, CASE WHEN banner % 3 > 0 THEN -10 ELSE 0 END AS human FROM f),
r AS (SELECT *, greatest(0, least(100, rhythm + pty + style + ban + human)) AS score, (rhythm > 0)::INT + (pty > 0)::INT + (style > 0)::INT + (ban > 0)::INT AS cats FROM p)
SELECT concat('u', user_id) AS "user", CASE WHEN keyed THEN concat('SHA256:k', user_id) ELSE '-' END AS fp, session_start, us, score, CASE WHEN score >= 70 AND cats >= 2 THEN 2 + (score >= 90)::INT WHEN score >= 40 THEN 1 ELSE 0 END AS rank FROM r"""


@query(VERDICTS_SQL)
def verdicts_of_lines(spark: SparkSession, d: str) -> DataFrame:
    server, audit = log_lines(spark, d)
    events = sshd_log.events(server, F.lit("2026-10-01").cast("timestamp")).unionByName(audit_log.events(audit)).withColumn("host", F.lit("web"))
    contents, _ = correlate.contents(stored(events.withColumn("seq", F.monotonically_increasing_id()), "events-of-lines"))
    found = running.verdicts(stored(contents, "contents-of-lines"), rules.default_pack())
    return found.select("user", "fp", "session_start", "us", "score", "rank")
