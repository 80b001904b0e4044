"""Queries that join: by time, range, rule, snapshot and set operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.functions import text
from tallyhound.functions.cron import cron_column
from tallyhound.operators import joins
from tallyhound.operators.sessions import DAY, micros
from tallyhound.plans.base import EV, HOUR, event_stream, query, table


@query(EV + ", p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT user_id, us, max(seq) AS last_click FROM ev WHERE event_type = 'click' GROUP BY ALL) SELECT p.seq, p.user_id, c.last_click FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us")
def asof_user_last(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d)
    clicks = e.filter("event_type = 'click'").withColumn("last_click", F.col("seq"))
    return joins.as_of(e.filter("event_type = 'purchase'"), clicks, key=["user_id"], take="last_click").select("seq", "user_id", "last_click")


@query(EV + ", l AS (SELECT k, us, max_by(user_id, seq) AS learned FROM ev WHERE event_type = 'signup' GROUP BY ALL), q AS (SELECT * FROM ev WHERE event_type = 'view') SELECT q.seq, q.k, l.learned FROM q ASOF LEFT JOIN l ON q.k = l.k AND q.us >= l.us")
def asof_uid_learned(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d)
    return joins.as_of(e.filter("event_type = 'view'"), e.filter("event_type = 'signup'").withColumn("learned", F.col("user_id")), key=["k"], take="learned").select("seq", "k", "learned")


@query(EV + f""", c AS (SELECT user_id, seq AS conn, us AS opened, least(coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, seq), us + {DAY}), us + {DAY}) AS closed FROM ev WHERE event_type = 'signup')
SELECT e.seq, c.conn FROM ev e JOIN c ON e.user_id = c.user_id AND e.us >= c.opened AND e.us < c.closed WHERE e.event_type <> 'signup'""")
def temporal_conn_join(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d)
    ends = F.least(F.coalesce(F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "seq")), F.col("us") + DAY), F.col("us") + DAY)
    conns = e.filter("event_type = 'signup'").withColumn("closed", ends).withColumn("conn", F.struct("seq", "closed"))
    found = joins.as_of(e.filter("event_type <> 'signup'"), conns, key=["user_id"], take="conn")
    return found.filter(F.col("us") < F.col("conn.closed")).select("seq", F.col("conn.seq").alias("conn"))


#: Freeze windows as hours since 1970-01-01, first listed first.
def _windows(first: int) -> list[tuple[str, int, int]]:
    at = first // DAY * DAY
    return [("night", at + k * DAY + 22 * HOUR, at + k * DAY + 30 * HOUR) for k in range(60)] + [("weekly", at + k * 7 * DAY, at + k * 7 * DAY + 3 * DAY) for k in range(9)]


_FROM = 1_704_067_200_000_000  # 2024-01-01


@query(EV + f""", w AS (SELECT 0 AS grp, i, 'night' AS name, {_FROM} + i * {DAY} + {22 * HOUR} AS a, {_FROM} + i * {DAY} + {30 * HOUR} AS b FROM range(60) t(i) UNION ALL SELECT 1, i, 'weekly', {_FROM} + i * {7 * DAY}, {_FROM} + i * {7 * DAY} + {3 * DAY} FROM range(9) t(i)),
j AS (SELECT seq, name, b, row_number() OVER (PARTITION BY seq ORDER BY grp, i) AS r FROM ev JOIN w ON us >= a AND us < b) SELECT seq, name AS freeze, b AS until_us FROM j WHERE r = 1""")
def freeze_range_join(spark: SparkSession, d: str) -> DataFrame:
    found = joins.in_first_interval(event_stream(spark, d), _windows(_FROM))
    return found.select("seq", F.col("interval").alias("freeze"), F.col("end_us").alias("until_us"))


@query("SELECT event_id AS seq FROM events WHERE extract(minute FROM ts) % 5 = 0 AND extract(hour FROM ts) BETWEEN 9 AND 17 AND extract(dow FROM ts) BETWEEN 1 AND 5")
def cron_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(cron_column("*/5 9-17 * * mon-fri", F.col("ts"))).select(F.col("event_id").alias("seq"))


#: Rules over host names, in order; later ones may match what earlier ones took.
RULES = [("probe", r"^(?:www\.)?[a-m]"), ("library", r"[0-9]"), ("human", r"\.(?:com|org)$")]


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '{p}') THEN '{n}'" for n, p in RULES) + " ELSE '' END AS rule FROM pages")
def first_match_rule(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "://([^/:?#]+)", 1))
    return table(spark, d, "pages").select("page_id", joins.first_match([(n, host.rlike(p)) for n, p in RULES]).alias("rule"))


FLAGS = ["token = ", "password=", "AKIA", "Licensed under"]


@query("SELECT doc_id, " + " OR ".join(f"contains(text, '{f}')" for f in FLAGS) + " AS flagged FROM documents")
def substring_any_rule(spark: SparkSession, d: str) -> DataFrame:
    flagged = F.lit(False)
    for f in FLAGS:
        flagged = flagged | F.col("text").contains(f)
    return table(spark, d, "documents").select("doc_id", flagged.alias("flagged"))


@query("WITH h AS (SELECT page_id, rtrim(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '.') AS h FROM pages) SELECT page_id, h = 'example.com' OR suffix(h, '.example.com') AS below, regexp_matches(h, '^th.*\\.example\\.com$') AS globbed FROM h")
def host_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    return table(spark, d, "pages").select("page_id", text.host_matches(host, "example.com").alias("below"), text.host_matches(host, "th*.example.com").alias("globbed"))


IP_SQL = "concat('10.', user_id % 4, '.', (user_id * 7) % 256, '.', event_id % 256)"


@query("SELECT event_id AS seq, ((10::BIGINT * 256 + user_id % 4) * 256 + (user_id * 7) % 256) * 256 + event_id % 256 AS number, user_id % 4 = 1 AS inside FROM events")
def cidr_range_match(spark: SparkSession, d: str) -> DataFrame:
    ip = F.concat(F.lit("10."), (F.col("user_id") % 4).cast("string"), F.lit("."), (F.col("user_id") * 7 % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
    number = text.ip_number(ip)
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), number.alias("number"), text.in_cidr(number, "10.1.0.0/16").alias("inside"))


@query("SELECT event_id AS seq, lower('20010db8' || lpad(to_hex(user_id % 4), 4, '0') || repeat('0', 16) || lpad(to_hex(event_id % 65536), 4, '0')) AS digits, user_id % 4 = 1 AS inside FROM events")
def cidr6_range_match(spark: SparkSession, d: str) -> DataFrame:
    ip = F.lower(F.concat(F.lit("2001:db8:"), F.hex(F.col("user_id") % 4), F.lit("::"), F.hex(F.col("event_id") % 65536)))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), text.ip6_hex(ip).alias("digits"), text.ip_in_cidr(ip, "2001:db8:1::/48").alias("inside"))



@query("SELECT event_id AS seq, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k, coalesce(json_extract_string(props, '$.k') = '7', false) AS is_seven FROM events")
def env_map_project(spark: SparkSession, d: str) -> DataFrame:
    fields = F.from_json("props", "map<string,string>")
    env = F.map_filter(F.transform_keys(fields, lambda k, v: F.concat(F.lit("env."), k)), lambda k, v: k.startswith("env."))
    k = F.try_element_at(env, F.lit("env.k"))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), k.alias("k"), F.map_contains_key(env, F.lit("env.k")).alias("has_k"), F.coalesce(k == "7", F.lit(False)).alias("is_seven"))


def _day(spark: SparkSession, d: str, n: int) -> DataFrame:
    return event_stream(spark, d).filter(F.floor(F.col("us") / DAY) == _FROM // DAY + n).groupBy("user_id").agg(F.max("k").alias("started"))


_DAYS_SQL = ", ".join(f"d{n} AS (SELECT user_id, max(k) AS started FROM ev WHERE us // {DAY} = {_FROM // DAY + n} GROUP BY ALL)" for n in (10, 11))


@query(EV + f", {_DAYS_SQL} SELECT coalesce(d10.user_id, d11.user_id) AS user_id, CASE WHEN d10.user_id IS NULL THEN 'new' WHEN d11.user_id IS NULL THEN 'gone' WHEN d10.started <> d11.started THEN 'reused' ELSE 'kept' END AS change FROM d10 FULL JOIN d11 ON d10.user_id = d11.user_id")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return joins.snapshot_difference(_day(spark, d, 10), _day(spark, d, 11), key=["user_id"], start="started")


@query(EV + f", {_DAYS_SQL} SELECT user_id FROM d11 ANTI JOIN d10 USING (user_id)")
def new_since_prev_anti(spark: SparkSession, d: str) -> DataFrame:
    return _day(spark, d, 11).join(_day(spark, d, 10), "user_id", "left_anti").select("user_id")


@query("WITH b AS (SELECT n_nationkey AS id, n_name AS name FROM nation), l AS (SELECT n_nationkey + 20 AS id, upper(n_name) || '*' AS name, n_nationkey % 3 = 0 AS disabled FROM nation WHERE n_nationkey < 10) SELECT coalesce(l.id, b.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.name ELSE b.name END AS name FROM b FULL JOIN l ON b.id = l.id WHERE NOT coalesce(l.disabled, false)")
def rule_overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    base = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    layer = n.filter("n_nationkey < 10").select((F.col("n_nationkey") + 20).alias("id"), F.concat(F.upper("n_name"), F.lit("*")).alias("name"), (F.col("n_nationkey") % 3 == 0).alias("disabled"))
    return joins.overlaid(base, layer, key="id")


@query("WITH RECURSIVE e AS (SELECT event_id AS node, event_id // 2 AS parent FROM events WHERE event_id > 0), c(node) AS (SELECT node FROM e WHERE node BETWEEN 5 AND 7 UNION SELECT e.node FROM e JOIN c ON e.parent = c.node) SELECT node FROM c")
def plumbing_closure(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "events").filter("event_id > 0").select(F.col("event_id").alias("node"), F.expr("event_id div 2").alias("parent"))
    return joins.closure(edges, edges.filter("node BETWEEN 5 AND 7").select("node"))


@query("SELECT epoch_us(ts) AS us, 'event' AS source, event_id AS seq FROM events UNION ALL SELECT epoch_us(o_orderdate), 'order', o_orderkey FROM orders")
def union_sources_sorted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(micros("ts").alias("us"), F.lit("event").alias("source"), F.col("event_id").alias("seq"))
    o = table(spark, d, "orders").select(micros("o_orderdate").alias("us"), F.lit("order").alias("source"), F.col("o_orderkey").alias("seq"))
    return e.unionByName(o).orderBy("us", "source", "seq")


@query("SELECT c.c_custkey, n.n_name AS country, count(o.o_orderkey) AS orders FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY ALL")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("orders"))  # grouped before the join
    named = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
    return named.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("n_name").alias("country"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT user_id, coalesce(c_name, user_id::VARCHAR) AS name, count(*) AS events FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY ALL")
def uid_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return per.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"), "left").select("user_id", F.coalesce("c_name", F.col("user_id").cast("string")).alias("name"), "events")


@query("SELECT seq, conv_id, previous FROM (SELECT conv_id * 1000 + turn AS seq, conv_id, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) WHERE previous IS NOT NULL")
def previous_turn(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "conv_id", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))
    return c.filter("previous IS NOT NULL")
