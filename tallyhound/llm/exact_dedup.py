"""Exact de-duplication over an extendible-hash index in shared files.

Every text is normalised and hashed once, into entries in the shared folder. The directory maps the leading bits of a
64-bit key to a bucket: a bucket with more than `bucket_rows` entries splits on one more bit, the directory doubling
where needed, up to a depth that follows the number of entries. The directory deals the work: all entries of a bucket go
to one owner task, which orders them by key and bytes, so that each run of equal bytes is one class and entries of one
key with other bytes are the next link of that key's chain. A bucket that is still overfull at full depth, as one key
may hold a third of all rows, is dealt to several owner tasks; the heads of their classes are compared in turn.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.llm.common import SPACE, documents, named, stored, text_or_empty

#: Most bits of the directory: it has at most 2 ** MAX_DEPTH rows of four numbers, which bounds what is broadcast.
MAX_DEPTH = 20


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def depth_for(rows: int, bucket_rows: int) -> int:
    """Bits of a prefix: four more than even buckets need, so that uneven ones have room to split."""
    return min(MAX_DEPTH, max(1, ceil(log2(max(2, rows / bucket_rows))) + 4))


def directory(keys: DataFrame, *, bucket_rows: int, depth: int) -> DataFrame:
    """(prefix, bucket, depth, parts) for each prefix of `depth` bits that occurs in keys (key).

    A bucket is named by its first prefix; its depth is the number of leading bits that its keys share. parts is the
    number of owner tasks, over one only where the bucket is overfull at full depth.
    """
    leaves = keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("prefix")).agg(F.count("*").alias("n"))
    at = F.expr("shiftright(prefix, full - level)")
    every = leaves.withColumn("full", F.lit(depth)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("at", at)
    every = every.withColumn("rows", F.sum("n").over(Window.partitionBy("level", "at")))
    # a prefix belongs to the first bucket on its way down that is not overfull, or is at full depth
    end = F.min(F.when((F.col("rows") <= bucket_rows) | (F.col("level") == depth), F.struct("level", "at", "rows")))
    found = every.groupBy("prefix").agg(end.alias("end"))
    return found.select(
        "prefix", F.expr(f"shiftleft(end.at, {depth} - end.level)").alias("bucket"), F.col("end.level").alias("depth"), F.ceil(F.col("end.rows") / F.lit(bucket_rows)).cast("int").alias("parts")
    )


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64, bucket_rows: int = 20_000) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256, bucket, depth.

    Texts are equal when identical without ASCII white space; null counts as empty, so empty, blank and null texts are
    equal. Of equal texts the one with the most code points in the original stays, then the smallest id, of any type; a
    null id counts as larger than any. Repeated rows (same id, same text) count in group_size and share one verdict;
    where all ids of a group are null, keep_id is null and exactly one row is kept. Other columns of df play no part,
    whatever their names. An empty df gives an empty result. bucket_rows is raised where the directory would outgrow
    MAX_DEPTH bits.
    """
    source = df.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    source = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").alias("code_points"), normalised(F.col("text")).alias("bytes"))
    entries = stored(source.withColumn("key", key(F.col("bytes")).cast("long")).withColumn("sha", F.unhex(F.sha2("bytes", 256))), "hashed-entries")
    total = entries.count()
    bucket_rows = max(bucket_rows, ceil(total / (1 << (MAX_DEPTH - 4))))
    depth = depth_for(total, bucket_rows)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(2 * total / bucket_rows))
    places = stored(directory(entries, bucket_rows=bucket_rows, depth=depth), "directory")

    # the owner tasks, whose number follows the rows so that none reads more on larger data: one exchange brings the entries of a bucket, or of one part of it, together
    owned = entries.withColumn("prefix", F.shiftrightunsigned("key", 64 - depth)).join(F.broadcast(places), "prefix")
    owned = owned.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).repartition(tasks, "bucket", "part")
    chain = Window.partitionBy("bucket", "part", "key").orderBy("bytes")
    same = Window.partitionBy("bucket", "part", "key", "bytes").orderBy("row")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.struct((-F.col("code_points")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    owned = owned.withColumn("chain", F.dense_rank().over(chain)).withColumn("n", F.count("*").over(whole)).withColumn("best", F.min(best).over(whole))
    first = (F.col("parts") > 1) & (F.row_number().over(same) == 1)
    index = stored(owned.withColumn("head", F.when(first, F.col("bytes"))).drop("bytes", "code_points", "prefix"), "extendible-index")

    # classes of one key in several parts: their heads, at most one a part and class, are compared with each other
    split = index.filter("parts > 1")
    heads = split.filter("head IS NOT NULL").select("bucket", "part", "key", "chain", "head", F.col("n").alias("own"), F.col("best").alias("own_best"))
    across = Window.partitionBy("key", "head")
    heads = heads.select("bucket", "part", "key", "chain", F.sum("own").over(across).alias("n"), F.min("own_best").over(across).alias("best"))
    split = split.drop("n", "best").join(heads, ["bucket", "part", "key", "chain"])
    out = index.filter("parts = 1").unionByName(split, allowMissingColumns=True)
    kept = F.when(F.col("best.doc_id").isNull(), F.col("row") == F.col("best.row")).otherwise(F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "depth")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("bucket", "depth")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT n, count(*) AS group_size, arg_min(doc_id, (-cp, doc_id)) AS keep_id FROM d GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM d JOIN g USING (n)
"""
