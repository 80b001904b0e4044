"""Timing features of a session's commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deduped(times: Column, gap: int) -> Column:
    """A sorted array of times without those less than `gap` after the last one kept."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(times, empty, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= gap), F.array_append(kept, t)).otherwise(kept))


def gaps(times: Column) -> Column:
    """Differences of successive times of a sorted array."""
    n = F.greatest(F.size(times) - 1, F.lit(0))
    return F.zip_with(F.slice(times, F.lit(2), n), F.slice(times, F.lit(1), n), lambda b, a: b - a)


def median(values: Column) -> Column:
    """The median of an array of whole numbers, the mean of the middle two rounded down; 0 for none."""
    s = F.array_sort(values)
    n = F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n <= 0, F.lit(0)).otherwise(F.floor((low + high) / 2)).cast("long")


def variation(values: Column) -> Column:
    """Population standard deviation over mean of an array; infinite for fewer than two values or a mean of 0 or less."""
    total = F.aggregate(values, F.lit(0).cast("double"), lambda a, x: a + x)
    mean = total / F.size(values)
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when((F.size(values) < 2) | (mean <= 0), F.lit(float("inf"))).otherwise(F.sqrt(square / F.size(values)) / mean)


def peak(times: Column, span: int) -> Column:
    """The most times of a sorted array that lie within any span, both ends included.

    One pass: a run of times grows by the next one where that fits, and else moves on by one, so that it never shrinks.
    """
    start = F.aggregate(times, F.lit(1), lambda first, t: F.when(t - F.element_at(times, first) > span, first + 1).otherwise(first))
    return F.when(F.size(times) > 0, F.size(times) - start + 1).otherwise(F.lit(0))


def peaks(df: DataFrame, *, key: list[str], us: str = "us", span: int) -> DataFrame:
    """(key, peak): as peak(), by a range frame over rows, for sessions of any length."""
    frame = Window.partitionBy(*key).orderBy(us).rangeBetween(-span, 0)
    return df.withColumn("_n", F.count("*").over(frame)).groupBy(*key).agg(F.max("_n").alias("peak"))


def features(events: DataFrame, *, key: list[str], us: str = "us", dedupe: int, span: int, cut: int) -> DataFrame:
    """One row per session: n, peak, median_gap (of gaps up to `cut`) and cv of its deduplicated times."""
    per = events.groupBy(*key).agg(F.sort_array(F.collect_list(us)).alias("_all"))
    per = per.withColumn("times", deduped(F.col("_all"), dedupe)).withColumn("_gaps", gaps(F.col("times")))
    return per.select(
        *key, F.size("times").alias("n"), F.size("_all").alias("n_raw"), peak(F.col("times"), span).alias("peak"), median(F.filter("_gaps", lambda g: g <= cut)).alias("median_gap"), variation(F.col("_gaps")).alias("cv"),
    )


def rhythm_clues(n: Column, peak_: Column, median_gap: Column, cv: Column, *, burst: int, regular: float, quick: int, sustained: int) -> dict[str, Column]:
    """The clues that timing gives, each with its weight where it holds and 0 elsewhere."""
    on = lambda c, w: F.when((n >= 4) & c, F.lit(w)).otherwise(F.lit(0))
    return {
        "rhythm.burst": on(peak_ >= burst, 20), "rhythm.regular": on((n >= 6) & (cv < regular), 10), "rhythm.subsecond": on((median_gap > 0) & (median_gap < quick), 10), "rhythm.sustained": on(n >= sustained, 10),
    }


def think_time(n: Column, median_gap: Column, cv: Column, *, low: int, high: int) -> Column:
    """The clue of pauses as long as a model takes to answer, and uneven."""
    return F.when((n >= 8) & median_gap.between(low, high) & (cv >= 0.5), F.lit(15)).otherwise(F.lit(0))
