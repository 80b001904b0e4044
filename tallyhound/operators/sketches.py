"""Counts in bounded space that can be merged: who fails most often, and how many hosts an account is on.

Both are Spark's own sketches, so that they combine before the shuffle, keep a fixed size as state of a stream, and may be
stored and merged later, over days or machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a frequency sketch tracks.
TRACKED = 1024


def frequencies(rows: DataFrame, item: str, *by: Column | str, tracked: int = TRACKED) -> DataFrame:
    """One row for each group with `sketch` of the items' frequencies and n, the rows counted. Null items do not count.

    tracked is at least the number of items that are asked for later.
    """
    return rows.filter(F.col(item).isNotNull()).groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(`{item}`, {int(tracked)})").alias("sketch"), F.count("*").alias("n"))


def bound(n: int, tracked: int = TRACKED) -> float:
    """How far an estimate may be from the exact count of an item, at most, over n rows: 3.5 n over the sketch's slots.

    A sketch has a power of two of slots and tracks items in three quarters of them. Items of a larger count than this are
    never missed.
    """
    slots = 8
    while 0.75 * slots < tracked:
        slots *= 2
    return 3.5 * n / slots


def heaviest(sketches: DataFrame, k: int, *by: str, tracked: int = TRACKED) -> DataFrame:
    """(by, item, count): the k most frequent items of frequencies() that are merged, estimated; counts of up to 0.75 times the slots' items are exact."""
    merged = sketches.groupBy(*by).agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("s"))
    return merged.select(*by, F.explode(F.expr(f"approx_top_k_estimate(s, {int(k)})")).alias("e")).select(*by, "e.item", "e.count")


def distinct_in_hops(rows: DataFrame, *, key: str, what: str, ts: str = "ts", span: str = "1 hour", hop: str = "5 minutes", late: str | None = None, lg: int = 12) -> DataFrame:
    """(key, start, end, sketch, n): for each window of `span` that starts each `hop`, a sketch of the distinct `what` of a key.

    With `late`, for streams: a window is given once the watermark has passed it, and is forgotten then. A key's state is
    a sketch for each of span / hop windows.
    """
    rows = rows if late is None else rows.withWatermark(ts, late)
    out = rows.groupBy(key, F.window(ts, span, hop).alias("w")).agg(F.hll_sketch_agg(what, lg).alias("sketch"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sketch", "n")


def on_many(hops: DataFrame, least: int = 2) -> DataFrame:
    """distinct_in_hops() with `distinct`, estimated, of at least some; few distinct values are counted exactly."""
    return hops.withColumn("distinct", F.hll_sketch_estimate("sketch")).filter(F.col("distinct") >= least).drop("sketch")
