"""Resharding by minimum-cost flow.

The old layout is known only by its block sizes: rows of one old shard and one size class. Blocks flow to the new
shards, whose capacities are given; a row that stays in its shard costs nothing, one that moves costs its bytes. The
flow is solved over shards and blocks, both bounded in number whatever the data, by successive shortest paths. Rows are
then dealt by their place in their block, so every capacity is met exactly and the fewest bytes move, to the precision
of a block. Only the files of shards that lose or gain a row are written anew.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.llm.common import documents, named, shared_folder, stored, text_or_empty

#: Size classes for each doubling of a row's bytes.
CLASSES = 2
#: Shards hold whole texts and are kept; snappy, Spark's default, takes 1.6 times the room on the documents of sf0.1.
CODEC = "zstd"


def min_cost_flow(amounts: np.ndarray, costs: np.ndarray, capacities: np.ndarray) -> np.ndarray:
    """x[block, shard], whole numbers: all of each block goes out, no shard gets more than its capacity, cost is least.

    Starts from every block in its cheapest shard, which is best for the loads that gives, and moves excess along the
    cheapest path of the residual graph of shards until no shard is over its capacity.
    """
    amounts, capacities = np.asarray(amounts, dtype=np.int64), np.asarray(capacities, dtype=np.int64)
    assert amounts.sum() <= capacities.sum(), "the capacities do not hold all rows"
    n, m = costs.shape
    x = np.zeros((n, m), dtype=np.int64)
    x[np.arange(n), costs.argmin(axis=1)] = amounts
    while (over := x.sum(axis=0) - capacities).max() > 0:
        # from shard a to b: the block in a that is the cheapest to move on
        delta = np.where(x[:, :, None] > 0, costs[:, None, :] - costs[:, :, None], np.inf)
        step, via = delta.min(axis=0), delta.argmin(axis=0)
        dist = np.where(over > 0, 0.0, np.inf)
        before = np.full(m, -1)
        for _ in range(m):
            through = dist[:, None] + step
            best, new = through.argmin(axis=0), through.min(axis=0)
            better = new < dist - 1e-9
            if not better.any():
                break
            dist, before = np.where(better, new, dist), np.where(better, best, before)
        ends = np.where(over < 0, dist, np.inf)
        path = [int(ends.argmin())]
        while before[path[0]] >= 0:
            path.insert(0, int(before[path[0]]))
        hops = [(a, b, int(via[a, b])) for a, b in zip(path, path[1:])]
        move = min(over[path[0]], -over[path[-1]], *[x[k, a] for a, _, k in hops])
        for a, b, k in hops:
            x[k, a] -= move
            x[k, b] += move
    return x


def size_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * CLASSES).cast("int")


def reshard(df: DataFrame, *, old_shard: Column, size: Column, capacities: list[int] | None = None, shards: int = 16, part_rows: int = 50_000) -> DataFrame:
    """df with old_shard, size, new shard and slot (gapless from 0 within it) for each row; counts are at most one apart.

    capacities (rows of each new shard) default to even ones. Null shards are shard 0. Rows are told apart by a number of
    their own, so repeated rows and rows without an id are placed once each. An empty df gives an empty result. df may
    have columns of any names but old_shard, size, shard and slot. Blocks are ranked in parts of about part_rows rows,
    however many rows a block has.
    """
    spark = df.sparkSession
    if clash := {"old_shard", "size", "shard", "slot"} & set(df.columns):
        raise ValueError(f"df has columns {sorted(clash)}")
    rows = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old"), size.cast("long").alias("size"), F.monotonically_increasing_id().alias("number"))
    rows = stored(rows.withColumn("class", size_class(F.col("size"))), "reshard-rows")
    blocks = sorted((tuple(r) for r in rows.groupBy("old", "class").agg(F.count("*"), F.sum("size")).collect()), key=lambda r: r[:2])  # old shards times size classes
    total = sum(r[2] for r in blocks)
    if capacities is None:
        capacities = [total // shards + (k < total % shards) for k in range(shards)]
    pieces = []
    if blocks:
        amounts, each = np.array([r[2] for r in blocks]), np.array([r[3] / r[2] for r in blocks])
        costs = np.where(np.array([r[0] for r in blocks])[:, None] == np.arange(len(capacities))[None, :], 0.0, each[:, None])
        x = min_cost_flow(amounts, costs, np.array(capacities))
        filled = np.zeros(len(capacities), dtype=np.int64)
        for k, (old, cls, *_) in enumerate(blocks):
            at = 0
            for shard in np.argsort(np.arange(len(capacities)) != old, kind="stable"):
                if n := int(x[k, shard]):
                    pieces.append((old, cls, int(shard), at, at + n, int(filled[shard])))
                    filled[shard] += n
                    at += n
    cuts = spark.createDataFrame(pieces, "old int, class int, shard int, first long, end long, slot long")  # bounded by blocks times shards
    block = ["old", "class", "part"]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(max(1, -(-total // part_rows)))))
    before = Window.partitionBy("old", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*block).agg(F.count("*").alias("n")).select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.join(parts.hint("shuffle_hash"), block).withColumn("rank", F.row_number().over(Window.partitionBy(*block).orderBy("number")) - 1 + F.col("start"))
    placed = placed.join(F.broadcast(cuts), ["old", "class"]).filter("rank >= first AND rank < end")
    return placed.select("row.*", F.col("old").alias("old_shard"), "size", "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))


def keyed(df: DataFrame) -> DataFrame:
    """df with _row, a number for each row, written so that the numbers stay: what a plan and the rewriting agree on."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")


def rewrite_affected(rows: DataFrame, plan: DataFrame, folders: dict[int, str], path: str, *, key: str = "_row", file_rows: int = 100_000) -> dict[int, str]:
    """Writes the shards that lose or gain a row into a new folder under path; returns the folder of each shard from now on.

    folders says where each old shard lies. Shards without a change keep their folder and their files, emptied ones have
    none, and no old file is altered: until the answer is in use the old folders hold everything, so that a job that
    fails leaves nothing half done. plan is reshard()'s result with `key`, which tells every row apart (see keyed());
    rows has `key` and the columns to write. They are shuffled once, to meet their places; each task then writes what it
    holds of a shard, by slot and at most file_rows a file, so that a shard has as many files as tasks or more.
    """
    moved = plan.filter("old_shard <> shard").agg(F.collect_set("shard"), F.collect_set("old_shard")).first()
    changed = sorted({*moved[0], *moved[1]})
    out = {k: v for k, v in folders.items() if k not in changed}
    if not changed:
        return out
    fresh = f"{path.rstrip('/')}/rewrite-{uuid.uuid4().hex}"
    new = plan.filter(F.col("shard").isin(changed)).select(named(key), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    new = stored(new, "rewritten-places")
    placed = rows.join(new.hint("shuffle_hash"), key).drop(key).sortWithinPartitions("_shard", "_slot").drop("_slot")
    placed.write.option("maxRecordsPerFile", file_rows).partitionBy("_shard").parquet(fresh, compression=CODEC)
    return out | {r[0]: f"{fresh}/_shard={r[0]}" for r in new.select("_shard").distinct().collect()}


def resharded(spark: SparkSession, docs: DataFrame, was: Column) -> DataFrame:
    """docs (doc_id, text) after all of it: written as old shards (`was`), planned, the changed shards written anew, and
    every shard read back from where it lies then: doc_id, text_crc32, shard, slot, size, old_shard."""
    old = shared_folder(spark, "old-shards")
    docs = docs.select("doc_id", "text", F.coalesce(was, F.lit(0)).cast("int").alias("_shard"), F.monotonically_increasing_id().alias("number"))
    docs.write.partitionBy("_shard").parquet(old, compression=CODEC)
    lying = spark.read.schema(docs.schema).parquet(old)
    plan = reshard(lying.select("number", F.octet_length(text_or_empty()).alias("bytes"), F.col("_shard").alias("was")), old_shard=F.col("was"), size=F.col("bytes") + 1)
    plan = stored(plan.select("number", "old_shard", "size", "shard", "slot"), "reshard-plan")
    folders = {r[0]: f"{old}/_shard={r[0]}" for r in plan.select("old_shard").distinct().collect()}  # as many as shards
    rows = lying.select(F.col("number").alias("_row"), "number", "doc_id", "text")
    folders = rewrite_affected(rows, plan.withColumnRenamed("number", "_row"), folders, shared_folder(spark, "new-shards"))
    held = [spark.read.schema(rows.drop("_row").schema).parquet(path).withColumn("shard", F.lit(k)) for k, path in sorted(folders.items())]
    found = reduce(DataFrame.unionByName, held) if held else rows.drop("_row").withColumn("shard", F.lit(0)).limit(0)
    return found.withColumn("text_crc32", F.crc32(text_or_empty())).drop("text").join(plan.hint("shuffle_hash"), ["number", "shard"]).drop("number")


def op2_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents lie in 12 shards by their source, one of them hot, and go to 16 shards of as many rows each."""
    docs = documents(spark, sf_dir)
    out = resharded(spark, docs, F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(12)))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
