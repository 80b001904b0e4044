"""Rules by the hundred thousand, as tables: host suffixes and address ranges joined by equality.

A CASE with a branch for each rule (joins.first_match) is right for a pack; a feed of rules is a table. A host is below
each of its own endings, and an address lies in one network of each prefix length, so the endings and the networks of a
value are looked up as keys. Distinct values are matched once, however many rows hold them, and the answer is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import text
from tallyhound.operators.joins import first_match
from tallyhound.sources.tables import stored

#: Rules with a star are no keys; so many of them may be compiled into an expression.
GLOBS = 200


def endings(host: Column) -> Column:
    """A host and what it is below: a.b.c, b.c, c. Lower case, without a final dot; nothing for an empty host."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(F.coalesce(host, F.lit("")) != "", every).otherwise(F.array().cast("array<string>"))


def _answered(rows: DataFrame, value: str, keys: DataFrame, rules: DataFrame, specific: bool, more: DataFrame | None = None) -> DataFrame:
    """rows with `rule`: of the rules whose key is one of a value's keys the first listed, or the longest and then the first.

    Only the first rule of a key can be an answer, so a key has one before it meets the values: what is joined grows with
    the values and the rules, not with the pairs of both that share a wide key.
    """
    order = [(-F.col("length")).alias("a"), F.col("ord").alias("b")] if specific else [F.col("ord").alias("a"), F.lit(0).alias("b")]
    best = F.struct(*order, "rule").alias("best")
    hits = keys.join(rules.select("key", best).groupBy("key").agg(F.min("best").alias("best")), "key").select("_value", "best")
    if more is not None:
        hits = hits.unionByName(more.select("_value", best))
    found = stored(hits.groupBy("_value").agg(F.min("best").alias("best")).select("_value", "best.rule"), "rule-answers")
    return rows.join(found, F.col(value) == F.col("_value"), "left").drop("_value").withColumn("rule", F.coalesce("rule", F.lit("")))


def host_rules(rows: DataFrame, rules: DataFrame, *, host: str, specific: bool = False) -> DataFrame:
    """rows with `rule`: the name of the first of rules (ord, suffix, rule) that the host equals or is below, '' for none.

    With `specific` the longest suffix goes before the order. Suffixes with a star are globs over the whole host and count
    as their own length; there may be GLOBS of them. Null and empty hosts match nothing; of rules of one ord the first by
    name counts. Repeated rows each get their answer.
    """
    rules = rules.select("ord", F.lower("suffix").alias("key"), "rule", F.length("suffix").alias("length")).filter("key <> ''")
    starred = sorted(rules.filter(F.col("key").contains("*")).limit(GLOBS + 1).collect(), key=lambda r: ((-r.length, r.ord) if specific else (r.ord,), r.rule))
    if len(starred) > GLOBS:
        raise ValueError(f"more than {GLOBS} rules with a star")
    values = stored(rows.select(F.col(host).alias("_value")).filter("_value IS NOT NULL AND _value <> ''").distinct(), "rule-values")
    keys = values.select("_value", F.explode(endings(F.col("_value"))).alias("key"))
    more = None
    if starred:
        at = first_match([(str(k), text.host_matches(F.col("_value"), r.key)) for k, r in enumerate(starred)]).try_cast("int")
        pick = lambda f, kind: F.element_at(F.array(*[F.lit(getattr(r, f)).cast(kind) for r in starred]), at + 1).alias(f)
        more = values.filter(at.isNotNull()).select("_value", pick("ord", "long"), pick("rule", "string"), pick("length", "int"))
    plain = rules.filter(~F.col("key").contains("*")).withColumn("ord", F.col("ord").cast("long"))
    return _answered(rows, host, keys, plain, specific, more)


def network(four: Column, six: Column, length: Column) -> Column:
    """The network of an address (text.ip_number and text.ip6_hex of it) with a prefix of some bits, as version:bits:address; null for no address."""
    kept = F.when(length <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", four, F.lit(32) - length) * F.pow(F.lit(2.0), F.lit(32) - length).cast("long"))
    # whole digits stay, the digit that the prefix ends in keeps its upper bits
    digits, bits = F.floor(length / 4).cast("int"), length % 4
    cut = F.conv(F.substr(six, digits + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2.0), F.lit(4) - bits).cast("int")
    last = F.when(bits > 0, F.lower(F.hex((F.floor(cut / step) * step).cast("long")))).otherwise("")
    net6 = F.rpad(F.concat(F.substr(six, F.lit(1), digits), last), 32, "0")
    return F.when(four.isNotNull() & (length <= 32), F.concat_ws(":", F.lit("4"), length.cast("string"), kept.cast("string"))).when(six.isNotNull() & four.isNull(), F.concat_ws(":", F.lit("6"), length.cast("string"), net6))


def range_rules(rows: DataFrame, rules: DataFrame, *, ip: str, specific: bool = False) -> DataFrame:
    """rows with `rule`: the name of the first of rules (ord, cidr, rule) whose range holds the address, '' for none.

    With `specific` the longest prefix goes before the order. A bare address is a range of one; v4 within v6 is v4. What
    is no address matches nothing, and rules that are no range are left out.
    """
    at, bits = F.substring_index("cidr", "/", 1), F.when(F.col("cidr").contains("/"), F.substring_index("cidr", "/", -1).try_cast("int"))
    full = F.when(text.ip_number(at).isNotNull(), 32).when(text.ip6_hex(at).isNotNull(), 128)
    r = rules.select(F.col("ord").cast("long").alias("ord"), "rule", F.coalesce(bits, full).alias("length"), full.alias("_full"), text.ip_number(at).alias("_four"), text.ip6_hex(at).alias("_six"))
    r = stored(r.filter("length BETWEEN 0 AND _full").drop("_full"), "rule-ranges")  # addresses are read once, not for each use of their numbers
    lengths = [(x.four, x.length) for x in r.select(F.col("_four").isNotNull().alias("four"), "length").distinct().collect()]  # 162 at most
    some = lambda four: F.array(*[F.lit(n) for v, n in lengths if v == four]).cast("array<int>")
    values = rows.select(F.col(ip).alias("_value")).filter("_value IS NOT NULL AND _value <> ''").distinct()
    values = stored(values.select("_value", text.ip_number(F.col("_value")).alias("_four"), text.ip6_hex(F.col("_value")).alias("_six")), "rule-values")
    keyed = lambda df, *more: df.select(*more, network(F.col("_four"), F.col("_six"), F.col("length")).alias("key")).filter("key IS NOT NULL")
    keys = keyed(values.select("_value", "_four", "_six", F.explode(F.when(F.col("_four").isNotNull(), some(True)).otherwise(some(False))).alias("length")), "_value")
    return _answered(rows, ip, keys, keyed(r, "ord", "rule", "length"), specific)
