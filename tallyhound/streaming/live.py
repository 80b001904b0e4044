"""Sessions and alerts over streams: the same rules as in batch, with state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyhound.operators.policy import CADENCE, Told


def session_counts(events: DataFrame, *, key: str = "user_id", ts: str = "ts", gap: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Events of each session of a key; a session is emitted once the watermark has passed its end."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


#: Groups that the keys of a stream of verdicts are dealt to: a call of Python costs milliseconds, whatever a group holds.
GROUPS = 2048


def freeze_spans(freezes: list[tuple[str, int, int]]) -> tuple[np.ndarray, list[tuple[str, int | None]]]:
    """(starts, (name, end) of each span): the times cut where a freeze starts or ends, each span with the first freeze listed that holds in it."""
    starts = sorted({t for _, start, end in freezes for t in (start, end) if start < end})
    held: list[tuple[str, int | None]] = [("", None)] * (len(starts) + 1)
    for name, start, end in reversed(freezes):
        if start < end:
            a, b = np.searchsorted(starts, [start, end], side="left")
            held[a + 1 : b + 1] = [(name, end)] * int(b - a)
    return np.array(starts, dtype=np.int64), held


def policy_stream(verdicts: DataFrame, *, key: str, cadence: int = CADENCE, forget: str = "15 minutes", freezes: list[tuple[str, int, int]] = ()) -> DataFrame:
    """Alerts of a stream of verdicts (key, ts, us, rank, declared): crossings of levels, declarations, freezes, reminders, ends.

    The state of a key is what it has been told (policy.Told), as in a batch; keys are dealt to GROUPS groups, and a task
    holds the live keys of one, those within `forget` of the watermark. freezes are (name, start, end) in
    microseconds, the end excluded, the first that holds counts; they go to every task. When the watermark passes `forget`
    after a key's last verdict, the key ends, which is told if it ever was an alert.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)
    kind = verdicts.schema[key].dataType.simpleString()
    starts, spans = freeze_spans(list(freezes))
    fields = ["top", "said", "last", "frozen", "seen"]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, *held = state.get if state.exists else ([] for _ in range(7))
        live = {k: [Told(cadence, int(top), bool(said), int(last), frozen, int(seen)), int(at)] for k, top, said, last, frozen, seen, at in zip(keys, *held)}
        watermark, out, fresh = state.getCurrentWatermarkMs(), [], set()
        for frame in [] if state.hasTimedOut else [pd.concat(list(frames))]:
            us, rank = frame["us"].to_numpy(), frame["rank"].to_numpy()
            order = np.lexsort((rank, us))
            us, span = us[order], np.searchsorted(starts, us[order], side="right")
            names = frame[key].astype(object).where(frame[key].notna(), None).to_numpy()[order]
            for k, t, r, d, n in zip(names.tolist(), us.tolist(), rank[order].tolist(), frame["declared"].to_numpy()[order].tolist(), span.tolist()):
                fresh.add(k)
                own = live.setdefault(k, [Told(cadence), 0])
                own[1] = max(own[1], t)
                if said := own[0].step(t, int(r), bool(d), *spans[n]):
                    out.append((k, t, *said))
        for k in [k for k, (_, at) in live.items() if k not in fresh and at // 1000 + wait < watermark]:
            told, at = live.pop(k)
            if told.top >= 2:
                out.append((k, at, "agent_ended", told.top))
        if live:
            tolds = [told for told, _ in live.values()]
            state.update((list(live), *([getattr(t, f) for t in tolds] for f in fields), [at for _, at in live.values()]))
            state.setTimeoutTimestamp(max(min(at for _, at in live.values()) // 1000 + wait, watermark + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "us", "event", "rank"])

    marked = verdicts.withWatermark("ts", "0 seconds").withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    held = f"keys array<{kind}>, top array<int>, said array<boolean>, last array<long>, frozen array<string>, seen array<int>, at array<long>"
    return marked.groupBy("_group").applyInPandasWithState(step, f"{key} {kind}, us long, event string, rank int", held, "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is and stops; the checkpoint lets a later run go on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
