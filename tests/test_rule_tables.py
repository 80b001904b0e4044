"""Rule tables against the compiled rules and against Python's own address ranges."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import joins, rule_tables
from tallyhound.functions import text


def answers(df, *cols):
    return sorted((tuple(r[c] for c in cols) + (r.rule,) for r in df.collect()), key=str)


def test_hosts_as_the_compiled_rules(spark):
    rules = [(0, "b.example.com", "b"), (1, "example.com", "all"), (2, "com", "com"), (3, "x*.org", "glob"), (4, "API.Net", "api"), (5, "api.net", "later"), (6, "a.b.example.com", "deep")]
    hosts = ["example.com", "a.b.example.com.", "B.EXAMPLE.com", "notexample.com", "xy.org", "a.xy.org", "api.net", "v1.api.net", "org", "", None, "example.com", "..", "com."]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, h string")
    table = spark.createDataFrame(rules, "ord int, suffix string, rule string")
    compiled = rows.withColumn("rule", F.coalesce(joins.first_match([(n, text.host_matches(F.col("h"), s)) for _, s, n in rules]), F.lit("")))
    assert answers(rule_tables.host_rules(rows, table, host="h"), "k", "h") == answers(compiled, "k", "h")
    got = {r.k: r.rule for r in rule_tables.host_rules(rows, table, host="h", specific=True).collect()}
    assert (got[0], got[1], got[2], got[3], got[4], got[7]) == ("all", "deep", "b", "com", "glob", "api")
    assert {r.rule for r in rule_tables.host_rules(rows, table.limit(0), host="h").collect()} == {""}
    with pytest.raises(ValueError, match="star"):
        rule_tables.host_rules(rows, spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("*."), F.col("id").cast("string")).alias("suffix"), F.lit("r").alias("rule")), host="h")


def test_ranges_as_python_has_them(spark):
    rnd = random.Random(9)
    v6 = lambda: ":".join(f"{rnd.choice([0x2001, 0xdb8, 1, rnd.randrange(65536)]):x}" for _ in range(8))
    v4 = lambda: f"10.{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(256)}"
    rules = [(k, f"{v4()}/{rnd.randrange(22, 33)}" if k % 2 else f"{v6()}/{rnd.choice([0, 16, 17, 33, 48, 63, 64, 126, 128])}", f"r{k}") for k in range(300)] + [(300, "10.1.1.7", "bare"), (301, "nonsense/8", "x"), (302, "10.0.0.0/40", "y")]
    ips = [v4() for _ in range(150)] + [v6() for _ in range(60)] + ["10.1.1.7", "::ffff:10.1.1.7", "2001::", "::", "no", "", None, "10.1.1.7"]
    rows = spark.createDataFrame(list(enumerate(ips)), "k int, ip string")
    table = spark.createDataFrame(rules, "ord int, cidr string, rule string")
    nets = []
    for k, c, name in rules[:301]:
        nets.append((k, ipaddress.ip_network(c, strict=False), name))

    def best(ip, specific):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return ""
        a = getattr(a, "ipv4_mapped", None) or a
        hit = [(k, n, name) for k, n, name in nets if n.version == a.version and a in n]
        return min(hit, key=lambda h: (-h[1].prefixlen if specific else 0, h[0]))[2] if hit else ""

    for specific in (False, True):
        got = {r.k: r.rule for r in rule_tables.range_rules(rows, table, ip="ip", specific=specific).collect()}
        assert got == {k: best(ip or "", specific) for k, ip in enumerate(ips)} and len(set(got.values())) > (20 if specific else 3)
    assert {r.rule for r in rule_tables.range_rules(rows, table.limit(0), ip="ip").collect()} == {""}


def test_a_hundred_thousand_rules(spark):
    n = 100_000
    table = spark.range(n).select(F.col("id").alias("ord"), F.format_string("h%d.example.com", "id").alias("suffix"), F.format_string("r%d", "id").alias("rule"))
    rows = spark.range(5000).select("id", F.format_string("x.h%d.example.com", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 31)).alias("h"))
    want = F.when(F.col("id") % 3 == 0, "r7").when(F.col("id") * 31 < n, F.format_string("r%d", F.col("id") * 31)).otherwise("")
    assert rule_tables.host_rules(rows, table, host="h").filter(F.col("rule") != want).count() == 0


def test_many_rules_of_one_wide_range(spark):
    n = 20_000  # in pairs of a value and a rule 400 million: only the first rule of a network may meet the values
    table = spark.range(n).select((F.lit(n) - F.col("id")).alias("ord"), F.format_string("10.%d.%d.0/8", F.col("id") % 256, F.floor(F.col("id") / 256)).alias("cidr"), F.format_string("r%d", "id").alias("rule"))
    rows = spark.range(n).select("id", F.format_string("10.1.%d.%d", F.floor(F.col("id") / 256), F.col("id") % 256).alias("ip"))
    began = time.monotonic()
    assert [tuple(r) for r in rule_tables.range_rules(rows, table, ip="ip").groupBy("rule").count().collect()] == [(f"r{n - 1}", n)]
    hosts = spark.range(n).select(F.col("id").alias("ord"), F.lit("example.com").alias("suffix"), F.format_string("h%d", "id").alias("rule"))
    asked = spark.range(n).select(F.format_string("a%d.example.com", "id").alias("h"))
    assert [tuple(r) for r in rule_tables.host_rules(asked, hosts, host="h").groupBy("rule").count().collect()] == [("h0", n)]
    assert time.monotonic() - began < 60  # the pairs of one key would be made by one task
