"""Sessions: runs of a key's events with no gap longer than a limit, and what is known of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def sessionised(df: DataFrame, *, key: list[str], us: str = "us", seq: str = "seq", gap: int) -> DataFrame:
    """df with session_start, the time of the first event of the run it is in. A gap of exactly `gap` is within a session.

    One shuffle by key; groupings by key and session_start afterwards need none.
    """
    order = Window.partitionBy(*key).orderBy(us, seq)
    opens = F.coalesce(F.col(us) - F.lag(us).over(order) > gap, F.lit(True))
    marked = df.withColumn("_opens", F.when(opens, F.col(us)))
    return marked.withColumn("session_start", F.last("_opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def sessionised_split(df: DataFrame, *, key: list[str], us: str = "us", seq: str = "seq", gap: int, span: int = 30 * DAY) -> DataFrame:
    """As sessionised(), for keys that may hold a large share of all events: no task gets more than a key's rows of one span.

    A span's first event needs only the last time before it, and its open session only the last start before it; both
    come from one row for each key and span.
    """
    parts = [*key, "_span"]
    df = df.withColumn("_span", F.floor(F.col(us) / span))
    ends = df.groupBy(*parts).agg(F.max(us).alias("_end"))
    ends = ends.select(*parts, F.lag("_end").over(Window.partitionBy(*key).orderBy("_span")).alias("_before"))
    order = Window.partitionBy(*parts).orderBy(us, seq)
    df = df.join(ends, parts)
    opens = F.coalesce(F.col(us) - F.coalesce(F.lag(us).over(order), F.col("_before")) > gap, F.lit(True))
    df = df.withColumn("_opens", F.when(opens, F.col(us)))
    starts = df.groupBy(*parts).agg(F.max("_opens").alias("_start"))
    carried = F.last("_start", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*parts, carried.alias("_carried"))
    here = F.last("_opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_here", here).join(starts, parts).withColumn("session_start", F.coalesce("_here", "_carried")).drop("_span", "_before", "_opens", "_here", "_carried")


def session_id(*parts: Column, prefix: str = "tr_", size: int = 12) -> Column:
    """An id made from what identifies a session, the same on every run."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, size))


def folded(alerts: DataFrame) -> DataFrame:
    """One row for each session_id of alerts (session_id, us, seq, score, rank, class, agent, event, in_freeze).

    The last event wins by time, then order; the score is the highest; a declared class goes before a suspected one and
    that before the first; the latest agent that is no guess goes before the first guess.
    """
    at = F.struct("us", "seq")
    guess = F.col("agent").startswith("?") | (F.col("agent") == "")
    return alerts.groupBy("session_id").agg(
        F.count("*").alias("alerts"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("event", at).alias("last_event"), F.max("score").alias("max_score"), F.max("rank").alias("max_rank"),
        F.coalesce(F.max(F.when(F.col("class") == "declared_agent", "declared_agent")), F.max(F.when(F.col("class") == "suspected_agent", "suspected_agent")), F.min_by("class", at)).alias("class"),
        F.coalesce(F.max_by(F.when(~guess, F.col("agent")), F.when(~guess, at)), F.min_by("agent", F.when(F.col("agent") != "", at)), F.lit("")).alias("agent"), F.bool_or("in_freeze").alias("in_freeze"),
    )
