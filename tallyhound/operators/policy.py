"""When a verdict becomes an alert: crossings of levels, reminders, freezes, ends."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the time after which a lasting alert is repeated.
CADENCE = 30 * 60 * 1_000_000


def crossings(verdicts: DataFrame, *, key: list[str], us: str = "us", seq: str = "seq") -> DataFrame:
    """The verdicts (rank) that are above every earlier one of their key, and at least info; prev is the highest before."""
    before = Window.partitionBy(*key).orderBy(us, seq).rowsBetween(Window.unboundedPreceding, -1)
    return verdicts.withColumn("prev", F.coalesce(F.max("rank").over(before), F.lit(0))).filter(F.col("rank") > F.col("prev"))


def reminded(times: Column, cadence: int = CADENCE) -> Column:
    """The times of a sorted array at which something is said: the first, then each at least `cadence` after the last said."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(times, empty, lambda out, t: F.when((F.size(out) == 0) | (t - F.element_at(out, -1) >= cadence), F.array_append(out, t)).otherwise(out))


@dataclass
class Told:
    """What a key has been told so far, and what its next verdict adds. The state that batches and streams share."""

    cadence: int = CADENCE
    top: int = 0  # highest level told
    said: bool = False  # that it is declared
    last: int = -1  # time of the last alert, -1 for none
    frozen: str = ""  # the freeze window that was violated last
    seen: int = 0  # highest level told in that window

    def step(self, us: int, rank: int, declared: bool, freeze: str = "", until: int | None = None) -> tuple[str, int] | None:
        """The alert (event, level) that a verdict gives, if any."""
        due, event, level = self.last < 0 or us - self.last >= self.cadence, None, rank
        high = "agent_high" if rank >= 3 else "agent_detected"
        if freeze and (declared or rank >= 1):
            window = f"{freeze}|{'' if until is None else until}"
            first, self.frozen = window != self.frozen, window
            if first:
                event, level = "freeze_violation", 3
            elif rank >= 2 and rank > self.seen:
                event = high
            elif due:
                event = "agent_still_active"
            if event:
                self.seen = rank if first else max(self.seen, rank)
        elif declared and not self.said:
            event, level, self.said = "agent_declared", 1, True
        elif rank >= 1 and not (declared and rank < 2):
            if rank > self.top:
                event = "info" if rank == 1 else high
            elif rank >= 2 and due:
                event = "agent_still_active"
        if event is None:
            return None
        self.top, self.last = max(self.top, level), us
        return event, level


def alerts(verdicts: DataFrame, *, key: list[str], cadence: int = CADENCE, ended: int | None = None, now: int | None = None) -> DataFrame:
    """The alerts (key, us, seq, event, rank) that each key's verdicts (us, seq, rank, declared, freeze, until) give, in order.

    freeze names the window that holds at that time, or is empty. In a freeze, a declared session or one of info and above
    is a violation once for each (freeze, until); later only what is higher than what was reported in that window, from alert on,
    or a reminder. Otherwise a declaration is told once; a level is told when it is above all told before; alert and
    above are repeated by the cadence. What was told raises the level, a violation to the highest. With `ended`, a key
    that was told of alert or above ends that long after its last verdict, if `now` is later: agent_ended, at its last
    verdict's us and seq.

    One pass over sorted rows; a task holds one key's state and no rows of it.
    """
    kinds = ", ".join(f"`{k}` {verdicts.schema[k].dataType.simpleString()}" for k in key)
    out_schema = f"{kinds}, us long, seq long, event string, rank int"
    columns = [*key, "us", "seq", "event", "rank"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, at = None, Told(cadence), (0, 0)

        def end() -> list[tuple]:
            return [(*own, *at, "agent_ended", state.top)] if own is not None and ended is not None and state.top >= 2 and now is not None and now - at[0] > ended else []

        for batch in batches:
            out: list[tuple] = []
            until = [None if pd.isna(u) else int(u) for u in batch["until"]]
            for k, us, seq, rank, declared, freeze, u in zip(zip(*[batch[c] for c in key]), batch["us"], batch["seq"], batch["rank"], batch["declared"], batch["freeze"], until):
                if k != own:
                    out += end()
                    own, state = k, Told(cadence)
                at = int(us), int(seq)
                if told := state.step(at[0], int(rank), bool(declared), freeze or "", u):
                    out.append((*k, *at, *told))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(end(), columns=columns)

    rows = verdicts.select(*key, "us", F.col("seq").cast("long").alias("seq"), "rank", "declared", "freeze", F.col("until").cast("long").alias("until"))
    return rows.repartition(*key).sortWithinPartitions(*key, "us", "seq").mapInPandas(fold, out_schema)
