"""Joins by time, by order of rules, by range and between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhound.sources.tables import stored


def as_of(left: DataFrame, right: DataFrame, *, key: list[str], us: str = "us", seq: str = "seq", take: str, span: int | None = None) -> DataFrame:
    """left with the latest `take` of right at or before each row's time, null if there is none.

    One union, one shuffle by key and one running window, instead of a range join; at equal times right comes first.
    """
    both = left.withColumn("_side", F.lit(1)).withColumn(take, F.lit(None).cast(right.schema[take].dataType)).unionByName(
        right.select(*key, us, seq, take).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(*key).orderBy(us, "_side", seq).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(take, F.last(take, ignorenulls=True).over(order)).filter("_side = 1").drop("_side")


def first_match(rules: list[tuple[str, Column]], otherwise: str = "") -> Column:
    """The name of the first rule, in order, whose condition holds: one expression, where a join by condition would be a nested loop."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def in_first_interval(df: DataFrame, intervals: list[tuple[str, int, int]], us: str = "us") -> DataFrame:
    """df with `interval`, the first listed (name, start, end) that holds its time, ends excluded; other rows go."""
    spark = df.sparkSession
    rows = spark.createDataFrame([(k, n, a, b) for k, (n, a, b) in enumerate(intervals)], "ord int, interval string, start_us long, end_us long")
    hours = 3_600_000_000  # intervals are cut into hours, so that the join is by equality first
    cut = rows.withColumn("_hour", F.explode(F.expr(f"sequence(start_us div {hours}, (end_us - 1) div {hours})")))
    found = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_hour", F.floor(F.col(us) / hours)).join(F.broadcast(cut), "_hour").filter((F.col(us) >= F.col("start_us")) & (F.col(us) < F.col("end_us")))
    first = Window.partitionBy("_row").orderBy("ord")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_row", "_hour", "_n", "ord")


def snapshot_difference(before: DataFrame, after: DataFrame, *, key: list[str], start: str) -> DataFrame:
    """key and change: new, gone, kept, or reused where the same key was started anew."""
    a = before.select(*key, F.col(start).alias("_was"))
    b = after.select(*key, F.col(start).alias("_is"))
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone").when(F.col("_was") != F.col("_is"), "reused").otherwise("kept")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def overlaid(base: DataFrame, layer: DataFrame, *, key: str, disabled: str = "disabled") -> DataFrame:
    """Rules of base and layer by key: the layer's replace or add, and those it disables go."""
    columns = [c for c in base.columns if c != key]
    joined = base.alias("b").join(layer.alias("l"), F.col(f"b.{key}") == F.col(f"l.{key}"), "full_outer")
    picked = [F.when(F.col(f"l.{key}").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns]
    return joined.select(F.coalesce(f"l.{key}", f"b.{key}").alias(key), *picked, F.coalesce(f"l.{disabled}", F.lit(False)).alias("_off")).filter("NOT _off").drop("_off")


def closure(edges: DataFrame, roots: DataFrame, *, node: str = "node", parent: str = "parent") -> DataFrame:
    """All nodes that have a root among their ancestors, or are one. One join a generation; each reached node once."""
    edges = stored(edges.select(node, parent), "closure-edges")
    reached = frontier = stored(roots.select(node).distinct(), "closure")
    while True:
        nearer = edges.join(frontier.withColumnRenamed(node, parent), parent).select(node).distinct().join(reached, node, "left_anti")
        frontier = stored(nearer, "closure")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
