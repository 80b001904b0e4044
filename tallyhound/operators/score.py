"""The additive score: weights by category, capped, summed, clamped; then level and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most that each category may add, the pager guards' share of style, the thresholds and the levels.
CAPS = {"banner": 35, "rhythm": 45, "pty": 15, "style": 30, "process": 45, "flags": 25, "network": 30, "identity": 0}
PAGER_CAP = 15
INFO, ALERT, HIGH = 40, 70, 90
LEVELS = ["none", "info", "alert", "high"]
PROTECTED = ["process", "flags", "identity"]


def capped(points: dict[str, Column], caps: dict[str, int] = CAPS) -> Column:
    """The sum of each category's points, none above its cap."""
    return sum((F.least(points[c], F.lit(caps[c])) for c in points), F.lit(0))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def rank(score: Column, info: int = INFO, alert: int = ALERT, high: int = HIGH) -> Column:
    """0 none, 1 info, 2 alert, 3 high."""
    return F.when(score >= high, 3).when(score >= alert, 2).when(score >= info, 1).otherwise(0)


def level(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank_.cast("int") + 1)


def downgraded(rank_: Column, categories: Column) -> Column:
    """Alert and above need two categories; with one only it is info."""
    return F.when((rank_ >= 2) & (categories < 2), 1).otherwise(rank_)


def verdicts(clues: DataFrame, *, key: list[str], thresholds: tuple[int, int, int] = (INFO, ALERT, HIGH)) -> DataFrame:
    """One row per key of clues (key, clue, category, weight, suppressed, declared): score, categories, rank, level, class, reasons.

    Suppressed clues do not count, but for protected categories. Pager guards share a cap within style. Interactive use
    does not speak against a session whose processes do.
    """
    shown = clues.filter(~F.col("suppressed") | F.col("category").isin(PROTECTED))
    plus = lambda cond: F.sum(F.when(cond & (F.col("weight") > 0), F.col("weight")).otherwise(0))
    pager = F.col("clue").startswith("style.pager_guard.")
    sums = [plus((F.col("category") == c) & ~pager).alias(f"_{c}") for c in CAPS]
    process = plus(F.col("category") == "process")
    minus = F.sum(F.when((F.col("weight") < 0) & (F.col("clue") != "pty.interactive"), F.col("weight")).otherwise(0))
    per = shown.groupBy(*key).agg(
        *sums, plus(pager).alias("_pager"), process.alias("_proc"), minus.alias("_minus"), F.sum(F.when(F.col("clue") == "pty.interactive", F.col("weight")).otherwise(0)).alias("_interactive"),
        F.max(F.col("declared")).alias("declared"), F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "clue"))).alias("reasons"),
    )
    points = {c: F.col(f"_{c}") + (F.least(F.col("_pager"), F.lit(PAGER_CAP)) if c == "style" else 0) for c in CAPS}
    score = clamped(capped(points) + F.col("_minus") + F.when(F.col("_proc") > 0, 0).otherwise(F.col("_interactive")))
    categories = sum((F.when(F.least(p, F.lit(CAPS[c])) > 0, 1).otherwise(0) for c, p in points.items()), F.lit(0))
    out = per.withColumn("score", score).withColumn("categories", categories)
    first = downgraded(rank(F.col("score"), *thresholds), F.col("categories"))
    said = F.coalesce(F.col("declared"), F.lit("")) != ""
    out = out.withColumn("rank", F.when(said, F.greatest(first, F.lit(1))).otherwise(first))
    out = out.withColumn("class", F.when(said, "declared_agent").when(F.col("rank") >= 2, "suspected_agent").otherwise("human"))
    return out.select(*key, "score", "categories", "rank", level(F.col("rank")).alias("level"), "class", F.transform("reasons", lambda r: r["clue"]).alias("reasons"))


def suppresses(rule: Column, clue: Column, category: Column) -> Column:
    """Whether a profile's entry covers a clue: its category, the clue itself, or a prefix of it up to a dot."""
    return (rule == category) | (rule == clue) | clue.startswith(F.concat(rule, F.lit(".")))


def match_ratio(hits: Column, texts: Column, channels: Column) -> Column:
    """Share of a session's commands that a profile knows, over its channels where those are more."""
    return hits / F.greatest(F.lit(1), texts, channels)
