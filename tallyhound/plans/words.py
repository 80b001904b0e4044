"""Queries over text: cleaning, redaction, command style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.functions import text
from tallyhound.operators import joins
from tallyhound.plans.base import query, table

CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[\n\r\t]', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g'), ' +', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, md5({CLEAN_SQL}) AS cleaned FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.cleaned(F.col("text"))).alias("cleaned"))


@query(r"WITH m AS (SELECT doc_id, trim(text, ' ') AS t, regexp_extract(text, '[ ;&|]+[a-z]+ing[a-z]*') AS m FROM documents), b AS (SELECT doc_id, CASE WHEN regexp_replace(m, '^[ ;&|]+', '') <> '' THEN regexp_replace(m, '^[ ;&|]+', '') ELSE regexp_extract(t, '^(\S+)', 1) END AS b FROM m) SELECT doc_id, CASE WHEN strlen(b) > 12 THEN substr(b, 1, list_max(list_filter(range(0, 13), lambda k: strlen(substr(b, 1, k)) <= 12))) || '…' ELSE b END AS fragment FROM b")
def text_fragment(spark: SparkSession, d: str) -> DataFrame:
    match = F.regexp_extract("text", r"[ ;&|]+[a-z]+ing[a-z]*", 0)
    return table(spark, d, "documents").select("doc_id", text.fragment(F.col("text"), match, 12).alias("fragment"))


@query(f"WITH c AS (SELECT doc_id, {CLEAN_SQL} AS c FROM documents) SELECT doc_id, CASE WHEN c = '' THEN '' ELSE CASE WHEN strlen(w) > 48 THEN substr(w, 1, list_max(list_filter(range(0, 49), lambda k: strlen(substr(w, 1, k)) <= 48))) || '…' ELSE w END || ' … (len ' || strlen(c) || ')' END AS redacted FROM (SELECT *, regexp_extract(c, '^([^ ]*)', 1) AS w FROM c)")
def text_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.redacted(F.col("text"), "argv0").alias("redacted"))


@query(r"WITH t AS (SELECT doc_id, substr(text, 1, 256) AS t FROM documents) SELECT doc_id, regexp_replace(substr(t, 1, list_max(list_filter(range(0, 257), lambda k: strlen(substr(t, 1, k)) <= 256))), '[\x00-\x1f\x7f-\x{9f}]', '?', 'g') AS shown FROM t")
def text_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.sanitised(F.col("text"), 256).alias("shown"))


@query("SELECT user_id, 'u_' || substr(sha256('pepper' || user_id::VARCHAR), 1, 12) AS pseudonym FROM (SELECT DISTINCT user_id FROM events)")
def hash_user(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", text.pseudonym(F.col("user_id").cast("string"), "pepper").alias("pseudonym"))


@query("WITH d AS (SELECT p_partkey, ' ' || upper(p_brand) || ' @v' || p_size AS said FROM part), a AS (SELECT DISTINCT lower(p_brand) AS alias, 'agent-' || substr(p_brand, -1) AS id FROM part WHERE p_size < 25) SELECT p_partkey, coalesce(id, lower(trim(split_part(said, '@', 1)))) AS agent FROM d LEFT JOIN a ON lower(trim(split_part(said, '@', 1))) = alias")
def declared_name_map(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    said = p.select("p_partkey", text.declared_name(F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" @v"), F.col("p_size").cast("string"))).alias("name"))
    alias = p.filter("p_size < 25").select(F.lower("p_brand").alias("name"), F.concat(F.lit("agent-"), F.substring("p_brand", -1, 1)).alias("id")).distinct()
    return said.join(alias, "name", "left").select("p_partkey", F.coalesce("id", "name").alias("agent"))


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(replace(p_name, ' ', '.'), '^[A-Za-z0-9._@:+-]{1,14}$') THEN replace(p_name, ' ', '.') ELSE 'invalid-declaration' END AS declared FROM part")
def declaration_check(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    return table(spark, d, "part").select("p_partkey", F.when(F.length(name) > 14, "invalid-declaration").otherwise(text.declared(name)).alias("declared"))


#: Signs of style in ordinary text, each with its weight, and its group where it shares a cap.
STYLES = [("addresses", r"[a-z0-9.]+@[a-z0-9.]+", 10, ""), ("chain", r"[;&|]", 8, ""), ("numbers", r"[0-9]{3,}", 5, "guard"), ("quotes", r"[\"']", 5, "guard"), ("dots", r"\.{2,}", 5, "guard"), ("shout", r"(?:^|[^A-Za-z])[A-Z]{4,}", 5, "guard"), ("dash", r" - ", 5, "")]


@query("SELECT doc_id, rule, weight FROM (SELECT doc_id, unnest([" + ", ".join("{'rule': '%s', 'weight': CASE WHEN regexp_matches(text, '%s') THEN %d ELSE 0 END}" % (n, p.replace("'", "''"), w) for n, p, w, _ in STYLES) + "], recursive := true) FROM documents) WHERE weight > 0")
def style_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.when(F.col("text").rlike(p), w).otherwise(0).alias("weight")) for n, p, w, _ in STYLES])
    return table(spark, d, "documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.rule", "h.weight").filter("weight > 0")


_ON = {g: " + ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for _, p, w, h in STYLES if h == g) for g in ("guard", "")}


@query(f"SELECT doc_id, least(30, least(15, {_ON['guard']}) + {_ON['']}) AS style FROM documents")
def style_group_cap(spark: SparkSession, d: str) -> DataFrame:
    points = lambda g: sum((F.when(F.col("text").rlike(p), w).otherwise(0) for _, p, w, h in STYLES if h == g), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.least(F.lit(30), F.least(F.lit(15), points("guard")) + points("")).alias("style"))


@query(r"""WITH p AS (SELECT page_id, list_distinct(regexp_extract_all(regexp_replace(url, '^[a-z]+://[^/]*', '') || ' "/var/log/' || page_id % 3 || '"', '(?:^|[\s=:''"])(/[A-Za-z0-9_.-]+/\S*)', 1)) AS paths FROM pages) SELECT page_id, len(paths) AS paths FROM p""")
def abs_path_extract(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.lit(' "/var/log/'), (F.col("page_id") % 3).cast("string"), F.lit('"'))
    return table(spark, d, "pages").select("page_id", F.size(F.array_distinct(text.absolute_paths(said))).cast("long").alias("paths"))


@query(r"SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages")
def base_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.base_name(F.regexp_replace("url", "[?#].*$", "")).alias("name"))


SHELLS = ["/bin/bash -c ", "-bash -c ", "fish -c ", "sh -c ", "bash -lc ", "csh -c ", ""]


@query("SELECT page_id, CASE WHEN page_id % 7 < 4 THEN '' WHEN page_id % 7 = 4 THEN 'bash -lc ' WHEN page_id % 7 = 5 THEN 'csh -c ' ELSE '' END || 'get ' || url AS command FROM pages")
def shell_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """Only a plain -c of a known shell is unwrapped: other flags are a tool's own wrapper."""
    said = F.concat(F.get(F.array(*map(F.lit, SHELLS)), (F.col("page_id") % 7).cast("int")), F.lit("get "), "url")
    return table(spark, d, "pages").select("page_id", text.shell_command(said).alias("command"))


@query("WITH e AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents) SELECT doc_id, md5(array_to_string(lines[:3], '; ') || CASE WHEN len(lines) > 3 THEN ' +' || (len(lines) - 3) || ' more' ELSE '' END) AS evidence FROM e")
def evidence_joined(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.md5(text.joined_evidence(lines)).alias("evidence"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS slack FROM pages")
def chat_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.slack_escaped(F.col("html"))).alias("slack"))


#: Profiles that know users by glob, the first listed one first.
USER_GLOBS = [("supplier-one", "Customer#00000000?"), ("tens", "Customer#0000000[1-3]*"), ("all", "Customer#*5")]


@query("SELECT c_custkey, CASE WHEN c_name GLOB 'Customer#00000000?' THEN 'supplier-one' WHEN c_name GLOB 'Customer#0000000[1-3]*' THEN 'tens' WHEN c_name GLOB 'Customer#*5' THEN 'all' ELSE '' END AS profile FROM customer")
def user_globs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", joins.first_match([(n, F.col("c_name").rlike(text.glob_pattern(g))) for n, g in USER_GLOBS]).alias("profile"))


@query("SELECT doc_id, list_aggregate(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 12)), 'count') AS long_words FROM documents")
def distinct_long_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 12)
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(words)).cast("long").alias("long_words"))
