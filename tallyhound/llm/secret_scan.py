"""Secret scanning with corpus-wide ownership frequencies.

Candidates are the base spans (assign, access, hex) and other long tokens of mixed letters and digits (live). The
hash of each candidate's value is counted over distinct owners and repositories: a value that many owners hold is a
widely copied example, one that a single owner holds in few repositories looks live. Live-looking tokens become spans of their own, so a
credential is found where no keyword stands beside it; base spans stay whatever their class. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import documents, join_by_group, named, stored, text_or_empty

#: Kind, pattern, group that holds the value, least length of that group.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"""AKIA[A-Z0-9]+""", 0, 20),
    ("hex", r"""[0-9a-f]{24,}""", 0, 24),
]
#: A token that may be a credential: it starts a run, has a digit and a letter, and at least 16 characters.
LIVE = ("live", r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}""", 0, 16)
_SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:bigint>>"


def spans_of(kind: str, pattern: str, group: int, least: int, order: int, text: str = "text") -> Column:
    """The spans of one kind in the column named by `text`: leftmost matches that do not overlap, those too short dropped.

    What split() leaves between the matches gives their places in code points.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"""
    CASE WHEN {text} RLIKE {p} THEN
      filter(aggregate(
        zip_with(slice(transform(split({text}, {p}, -1), x -> length(x)), 1, size(regexp_extract_all({text}, {p}, 0))),
                 arrays_zip(regexp_extract_all({text}, {p}, 0) AS hit, regexp_extract_all({text}, {p}, {group}) AS val),
                 (gap, m) -> struct(gap, m['0'] AS hit, m['1'] AS val)),
        struct(0 AS at, cast(array() AS array<struct<start:int,ord:int,kind:string,end:int,value:bigint,size:int>>) AS out),
        (a, x) -> struct(a.at + x.gap + length(x.hit) AS at, concat(a.out, array(struct(
          a.at + x.gap AS start, {order} AS ord, '{kind}' AS kind, a.at + x.gap + length(x.hit) AS end, xxhash64(x.val) AS value, length(x.val) AS size))) AS out),
        a -> a.out), x -> x.size >= {least})
    END""".replace(" AS hit, regexp", ", regexp").replace(f", {group}) AS val)", f", {group}))"))


def candidates(df: DataFrame) -> DataFrame:
    """df (text) with `base` and `extra` in place of the text: spans by start, then kind as listed; extra spans overlap no base span."""
    cols = [c for c in df.columns if c != "text"]
    for i, kind in enumerate([*KINDS, LIVE]):
        df = df.withColumn(f"_{i}", spans_of(*kind, i))
    pick = lambda i: F.coalesce(F.expr(f"transform(_{i}, x -> struct(x.start, x.ord, x.kind, x.end, x.value))").cast(_SPAN), F.array().cast(_SPAN))
    df = df.select(*cols, F.array_sort(F.concat(*[pick(i) for i in range(len(KINDS))])).alias("base"), pick(len(KINDS)).alias("extra"))
    return df.withColumn("extra", F.expr("filter(extra, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))"))


def owned(found: DataFrame, example_owners: int, live_repos: int) -> DataFrame:
    """value, n, owners, repos, class of each candidate value of `found` (value, owner, repo).

    Counted in steps that each combine before the shuffle, so that a value in a third of all rows is no hot spot.
    """
    by_repo = found.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    out = by_owner.groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") == 1) & (F.col("repos") <= live_repos)
    return out.withColumn("class", F.when(F.col("owners") >= example_owners, "example").when(live, "live").otherwise("shared"))


#: Owners from which on a value is an example, and the most repositories of its one owner in which it still looks live.
EXAMPLE_OWNERS, LIVE_REPOS = 4, 3


def _scanned(df: DataFrame, text_col: str, owner: Column | None, repo: Column | None, cols: list[str]) -> DataFrame:
    """(row, doc, base, extra, owner, repo), written once: doc holds the columns `cols` of df, row is a number of its own."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    docs = df.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[named(c) for c in cols]).alias("doc"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), text_or_empty(text_col).alias("text"),
    )
    return stored(candidates(docs), "secret-candidates")


def classed(scanned: DataFrame, example_owners: int, live_repos: int) -> DataFrame:
    """(row, spans) of the rows that keep a span: all of base, and what of extra looks live, each with its class."""
    each = scanned.filter("size(base) + size(extra) > 0").select("row", "owner", "repo", F.explode(F.concat("base", "extra")).alias("s"))
    held = stored(owned(each.select("s.value", "owner", "repo"), example_owners, live_repos), "secret-owners")
    total = max(1, held.agg(F.sum("n")).first()[0] or 0)
    kept = join_by_group(each.select("row", "s", "s.value"), held, "value", "n", total).filter("s.ord < 3 OR class = 'live'")
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.ord", "s.kind", "s.end", "s.value", "class"))).alias("spans"))


def secret_scan(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, example_owners: int = EXAMPLE_OWNERS, live_repos: int = LIVE_REPOS
) -> DataFrame:
    """One row per row of df: id_col, base spans, spans (with class), as arrays of structs.

    A value that `example_owners` owners hold or more is an example; one that a single owner holds in up to `live_repos`
    repositories looks live; others are shared. owner and repo default to source and source with lang; null owners are
    one owner. Null text counts as empty and has no spans; long texts are read whole; repeated rows, and rows without an
    id, each get their spans; extra columns of df are ignored, whatever their names; an empty df gives an empty result.
    """
    scanned = _scanned(df, text_col, owner, repo, [id_col])
    out = scanned.join(classed(scanned, example_owners, live_repos), "row", "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:bigint,class:string>>")
    return out.select(F.col("doc")[id_col].alias(id_col), "base", F.coalesce("spans", none).alias("spans"))


def redacted(df: DataFrame, *, text_col: str = "text", owner: Column | None = None, repo: Column | None = None, example_owners: int = EXAMPLE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """df, every span masked in its text: [SECRET], or [EXAMPLE] where many owners hold the value. All rows stay.

    Rows without a candidate are not shuffled. n_chars, where df has it, follows the new text; null texts stay null.
    Columns of any name pass unchanged. owner and repo as in secret_scan().
    """
    cols = df.columns
    scanned = _scanned(df, text_col, owner, repo, cols)
    hit = scanned.filter("size(base) + size(extra) > 0").select("row", "doc").join(classed(scanned, example_owners, live_repos), "row", "left").withColumn("text", F.col("doc")[text_col])
    masked = F.expr("""aggregate(spans, struct('' AS out, 0 AS at),
        (a, s) -> CASE WHEN s.end <= a.at THEN a ELSE struct(
          concat(a.out, CASE WHEN s.start >= a.at THEN concat(substr(text, a.at + 1, s.start - a.at), IF(s.class = 'example', '[EXAMPLE]', '[SECRET]')) ELSE '' END) AS out, s.end AS at) END,
        a -> concat(a.out, substr(text, a.at + 1)))""")
    hit = hit.withColumn("masked", F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked))
    own = {text_col: F.col("masked"), "n_chars": F.when(F.col("spans").isNull(), F.col("doc")["n_chars"]).otherwise(F.length("masked").cast("long"))} if "n_chars" in cols else {text_col: F.col("masked")}
    rest = scanned.filter("size(base) + size(extra) = 0").select(*[F.col("doc")[c].alias(c) for c in cols])
    return rest.unionByName(hit.select(*[own.get(c, F.col("doc")[c]).alias(c) for c in cols]))


def listing(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    count = lambda what: F.expr(f"size(filter({what}))").cast("long")
    return found.select(
        "doc_id", *[count(f"base, x -> x.kind = '{k[0]}'").alias(f"n_{k[0]}") for k in KINDS], F.sha2(listing("base"), 256).alias("base_sha256"), listing("spans").alias("spans"),
        count("spans, x -> x.class = 'live'").alias("n_live"), count("spans, x -> x.class = 'example'").alias("n_example"),
    )


def _sql_spans(kind: str, pattern: str, group: int, least: int, order: int) -> str:
    q = pattern.replace("'", "''")
    return f"""
  SELECT rid, {order} AS ord, '{kind}' AS kind, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i-1], lambda x: length(x))), 0) AS s, length(hits[i]) AS len, vals[i] AS val
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '{q}') AS hits, regexp_extract_all(t, '{q}', {group}) AS vals, string_split_regex(t, '{q}') AS gaps FROM d)) WHERE length(vals[i]) >= {least}"""


_LIVE_SQL = r"""
  SELECT rid, 3 AS ord, 'live' AS kind, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i-1], lambda x: length(x))), 0) AS s, length(hits[i]) AS len, hits[i] AS val
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(t, '[A-Za-z0-9+/_-]{16,}') AS hits, string_split_regex(t, '[A-Za-z0-9+/_-]{16,}') AS gaps FROM d)) WHERE regexp_matches(hits[i], '[0-9]') AND regexp_matches(hits[i], '[A-Za-z]')"""
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS ({' UNION ALL '.join(_sql_spans(*k, i) for i, k in enumerate(KINDS))}),
live AS (SELECT * FROM ({_LIVE_SQL}) x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.s + x.len AND x.s < b.s + b.len)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM live),
held AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM found JOIN d USING (rid) GROUP BY val),
spans AS (SELECT f.*, owners, owners = 1 AND repos <= {LIVE_REPOS} AS live, concat(kind, ':', s::BIGINT, ':', (s + len)::BIGINT) AS said FROM found f JOIN held USING (val) WHERE ord < 3 OR (owners = 1 AND repos <= {LIVE_REPOS})),
per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(said, ',' ORDER BY s, ord) FILTER (ord < 3) AS b, string_agg(said, ',' ORDER BY s, ord) AS a, count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN per USING (rid)
"""
