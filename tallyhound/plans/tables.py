"""Rules as tables: hosts of pages and addresses of events, looked up among as many rules as there are suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.operators import rule_tables
from tallyhound.plans.base import query, table

HOSTS_SQL = """WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM pages),
r AS (SELECT DISTINCT host AS suffix FROM h WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_replace(host, '^[^.]*\\.', '') FROM h WHERE page_id % 7 = 0 AND host LIKE '%.%.%'),
m AS (SELECT page_id, suffix, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC, suffix) AS n FROM h JOIN r ON suffix <> '' AND (host = suffix OR ends_with(host, '.' || suffix)))
SELECT page_id, coalesce(suffix, '') AS rule FROM h LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (page_id)"""


@query(HOSTS_SQL)
def host_rule_table(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/:?#]+)", 1)).alias("host"))
    above = h.filter("page_id % 7 = 0 AND host LIKE '%.%.%'").select(F.regexp_replace("host", r"^[^.]*\.", "").alias("suffix"))
    rules = h.filter("page_id % 3 = 0").select(F.col("host").alias("suffix")).unionByName(above).distinct()
    rules = rules.select(F.xxhash64("suffix").alias("ord"), "suffix", F.col("suffix").alias("rule"))  # no two suffixes of a host have one length
    return rule_tables.host_rules(h, rules, host="host", specific=True).select("page_id", "rule")


RANGES_SQL = """WITH ips AS (SELECT event_id AS seq, 167772160 + (user_id % 64) * 65536 + ((user_id * 7) % 256) * 256 + event_id % 256 AS ip FROM events),
r AS (SELECT c_custkey AS ord, 8 + c_custkey % 25 AS length, 167772160 + (c_custkey % 64) * 65536 + ((c_custkey * 11) % 256) * 256 + c_custkey % 256 AS addr FROM customer),
b AS (SELECT ord, (addr >> (32 - length)) << (32 - length) AS low, 1::BIGINT << (32 - length) AS size FROM r WHERE length > 9),
f AS (SELECT seq, min(ord) AS ord FROM ips JOIN b ON ip >= low AND ip < low + size GROUP BY seq)
SELECT seq, coalesce('c' || ord, '') AS rule FROM ips LEFT JOIN f USING (seq)"""


@query(RANGES_SQL)
def range_rule_table(spark: SparkSession, d: str) -> DataFrame:
    dotted = lambda a, b, c: F.format_string("10.%d.%d.%d", a, b, c)
    ips = table(spark, d, "events").select(F.col("event_id").alias("seq"), dotted(F.col("user_id") % 64, F.col("user_id") * 7 % 256, F.col("event_id") % 256).alias("ip"))
    k = F.col("c_custkey")
    rules = table(spark, d, "customer").filter(k % 25 > 1).select(k.alias("ord"), F.format_string("%s/%d", dotted(k % 64, k * 11 % 256, k % 256), 8 + k % 25).alias("cidr"), F.format_string("c%d", k).alias("rule"))
    return rule_tables.range_rules(ips, rules, ip="ip").select("seq", "rule")
