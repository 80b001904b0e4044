"""A verdict at each event of a session, in one pass.

What an event says by itself (the styles that a command shows, the profiles' clauses that it meets, the agent that a
process is, the service that a connection calls) is found by expressions compiled from the rule pack. The rows then go
through a fold in the order of each session's events: it holds running figures of the session's timing, counts of hits and
the live processes, and gives the clues, the score and the level that the session has at that moment. The last of a
session's verdicts is the one that detect.verdicts() gives for the whole of it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import text
from tallyhound.operators import correlate, detect, score
from tallyhound.operators.joins import first_match
from tallyhound.sources.rules import Pack, Profile

DEDUPE, SPAN, CUT = 200_000, 300 * detect.SECOND, 60 * detect.SECOND
TRACK = detect.TRACK
FLAGS = ["execs", "shell", "closes", "command", "channel", "spoken", "named", "env", "flags", "service", "attributed"]


def _all(tests: list[Column]) -> Column:
    return F.array(*tests) if tests else F.array().cast("array<boolean>")


def facts(rows: DataFrame, pack: Pack) -> DataFrame:
    """What each row of correlate.contents() says by itself, for the fold."""
    c, p = F.struct("cmd", "argv0"), F.struct("us", "pid", "fields", "attributed")
    is_command, is_process, is_call, is_banner = F.col("origin").isNotNull(), F.col("kind") == "proc.seen", F.col("kind") == "net.conn", F.col("kind") == "ssh.banner"
    own = F.coalesce(F.col("opened") >= F.col("session_start"), F.lit(False))  # of a connection that was opened in this session
    banner = F.col("_banner")
    clauses = [(p_, x) for p_ in pack.profiles for x in p_.any_of if x.required]
    named, env = detect.agent_of_process(detect.shown(p), pack), detect.agent_of_env(p, pack)
    mark = F.when(F.col("attributed"), text.declared(F.coalesce(F.try_element_at("fields", F.lit("env.AI_AGENT")), F.lit(""))))
    spoken = is_command & ((F.col("cmd") != "") | (F.col("argv0") != ""))
    rows = rows.withColumn("_banner", F.when(is_banner & own, correlate.banner_text()))
    out = rows.select(
        *TRACK, "us", "seq", "kind", "pid", "attributed", F.when(own, F.col("conn")).alias("conn"), "opened", is_command.alias("command"), (is_command & (F.col("origin") == "sshlog")).alias("channel"),
        spoken.alias("spoken"), F.when(is_command, _all([F.rlike("cmd", F.lit("(?i)" + s.regex)) for s in pack.styles])).alias("styles"),
        F.when(spoken, _all([detect._either([detect.clause_met(c, x) for x in q.any_of]) for q in pack.profiles])).alias("met"), F.when(spoken, _all([detect.clause_met(c, x) for _, x in clauses])).alias("required"),
        (own & correlate.command_channel()).alias("execs"), (own & correlate.shell_channel()).alias("shell"), (own & correlate.closes()).alias("closes"), F.when(own, correlate.said_here()).alias("said"),
        banner.alias("banner"), F.when(banner.isNotNull(), first_match([(r.kind, F.rlike(banner, F.lit("(?i)" + r.regex))) for r in pack.banners])).alias("banner_kind"),
        F.when(banner.isNotNull(), _all([detect._any(banner, [x.banner_regex for x in q.any_of if x.banner_regex]) for q in pack.profiles])).alias("banner_met"),
        F.when(banner.isNotNull(), _all([detect._any(banner, [x.banner_regex] if x.banner_regex else []) for _, x in clauses])).alias("banner_required"),
        F.when(is_process, (detect._field(p, "agent") != "") | (named != "")).alias("named"), F.when(is_process, env != "").alias("env"), F.when(is_process, F.size(detect.skip_flags(p, pack)) > 0).alias("flags"),
        F.when(is_process, F.when(~mark.isin("", "invalid-declaration"), mark)).alias("marked"), F.when(is_call, detect.host_agent(p, pack) != "").alias("service"),
        _all([_who(q) for q in pack.profiles]).alias("who"),
    )
    return out.fillna(False, FLAGS)


def _who(p: Profile) -> Column:
    """Whether a session's user, address and key are those of a profile."""
    out = F.lit(bool(p.users or p.src_cidrs or p.fingerprints or p.any_of))
    if p.users:
        out = out & detect._any(F.col("user"), [text.glob_pattern(u) for u in p.users])
    if p.src_cidrs:
        out = out & detect._either([text.ip_in_cidr(F.col("src_ip"), c) for c in p.src_cidrs])
    if p.fingerprints:
        out = out & F.col("fp").isin(*p.fingerprints)
    return F.coalesce(out, F.lit(False))


class Gaps:
    """Running figures of the gaps between times that only grow: their number, variation, and the median of those up to a limit."""

    def __init__(self, cut: int = CUT):
        self.n = self.total = self.squares = 0
        self.cut, self.low, self.high = cut, [], []  # a heap of each half of the gaps up to the limit

    def add(self, gap: int) -> None:
        self.n, self.total, self.squares = self.n + 1, self.total + gap, self.squares + gap * gap
        if gap <= self.cut:
            heapq.heappush(self.high, -heapq.heappushpop(self.low, -gap))
            if len(self.high) > len(self.low):
                heapq.heappush(self.low, -heapq.heappop(self.high))

    @property
    def median(self) -> int:
        if not self.low:
            return 0
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) // 2

    @property
    def variation(self) -> float:
        return math.inf if self.n < 2 or self.total <= 0 else math.sqrt(self.n * self.squares - self.total**2) / self.total


@dataclass
class Rules:
    """What the fold needs of a rule pack, as plain values."""

    styles: list[tuple[str, int, int]]  # clue, weight, least commands
    profiles: list[tuple[float, bool, list[int], int | None, list[str]]]  # least share, has clauses, places of required ones, cap, suppressed
    required: list[bool]  # whether a banner may meet it
    thresholds: tuple[int, int, int]

    @classmethod
    def of(cls, pack: Pack, thresholds: tuple[int, int, int]) -> Rules:
        profiles, required = [], []
        for p in pack.profiles:
            own = [x for x in p.any_of if x.required]
            profiles.append((p.min_match_ratio, bool(p.any_of), list(range(len(required), len(required) + len(own))), p.max_score, list(p.suppress)))
            required += [bool(x.banner_regex) for x in own]
        return cls([(detect.style_id(s), s.weight, s.min_commands) for s in pack.styles], profiles, required, thresholds)


@dataclass
class Session:
    """A session so far."""

    rules: Rules
    last: int | None = None  # deduplicated times: the last, their number, those of the last five minutes, the most of these
    n: int = 0
    near: deque = field(default_factory=deque)
    peak: int = 0
    gaps: Gaps = field(default_factory=Gaps)
    channel: int | None = None
    channels: int = 0
    channel_gaps: Gaps = field(default_factory=Gaps)
    execs: int = 0
    shells: int = 0
    conns: dict = field(default_factory=dict)  # conn: [opened, shell opened, closed, banner, kind, met, required, declared]
    processes: dict = field(default_factory=dict)  # pid: (named, env, flags, marked)
    first_seen: dict = field(default_factory=dict)
    services: set = field(default_factory=set)
    texts: int = 0
    styles: Counter = field(default_factory=Counter)
    met: Counter = field(default_factory=Counter)
    required: set = field(default_factory=set)

    def add(self, r) -> None:  # noqa: ANN001
        us = int(r.us)
        if r.command:
            if self.last is None or us - self.last >= DEDUPE:
                if self.last is not None:
                    self.gaps.add(us - self.last)
                self.last, self.n = us, self.n + 1
                self.near.append(us)
                while us - self.near[0] > SPAN:
                    self.near.popleft()
                self.peak = max(self.peak, len(self.near))
            if r.channel:
                if self.channel is not None:
                    self.channel_gaps.add(us - self.channel)
                self.channel, self.channels = us, self.channels + 1
            self.styles.update(k for k, hit in enumerate(r.styles) if hit)
            if r.spoken:
                self.texts += 1
                self.met.update(k for k, hit in enumerate(r.met) if hit)
                self.required.update(k for k, hit in enumerate(r.required) if hit)
        if r.conn is not None:
            c = self.conns.setdefault(r.conn, [int(r.opened), None, None, None, "", (), (), None])
            self.execs, self.shells = self.execs + bool(r.execs), self.shells + bool(r.shell)
            if r.shell and c[1] is None:
                c[1] = us
            if r.closes and c[2] is None:
                c[2] = us
            if r.banner is not None:
                c[3:7] = r.banner, r.banner_kind, tuple(r.banner_met), tuple(r.banner_required)
            if r.said is not None:
                c[7] = r.said
        if r.kind == "proc.seen":
            self.first_seen.setdefault(r.pid, us)
            self.processes[r.pid] = (bool(r.named), bool(r.env), bool(r.flags), r.marked)
        elif r.kind == "proc.gone":
            self.first_seen.setdefault(r.pid, us)
            self.processes.pop(r.pid, None)
        elif r.kind == "net.conn" and r.service:
            self.services.add(bool(r.attributed))

    @property
    def declared(self) -> bool:
        return any(c[7] for c in self.conns.values()) or any(p[3] for p in self.processes.values())

    def clues(self, now: int) -> dict[str, tuple[str, int]]:
        """clue: (category, weight), for those that hold."""
        out = {}
        limit = detect.LIMITS
        if self.n >= 4:
            middle = self.gaps.median
            out["rhythm.burst"] = "rhythm", 20 * (self.peak >= limit["burst"])
            out["rhythm.regular"] = "rhythm", 10 * (self.n >= 6 and self.gaps.variation < limit["regular"])
            out["rhythm.subsecond"] = "rhythm", 10 * (0 < middle < limit["quick"])
            out["rhythm.sustained"] = "rhythm", 10 * (self.n >= limit["sustained"])
            pause = self.channel_gaps
            out["rhythm.think_time"] = "rhythm", 15 * (self.channels >= 8 and 1_500_000 <= pause.median <= 30 * detect.SECOND and pause.variation >= 0.5)
        for kind in {c[4] for c in self.conns.values() if c[3] is not None and c[4]}:
            out[f"banner.{kind}"] = "banner", detect.BANNER.get(kind, 0)
        out["pty.none"] = "pty", 15 * (self.execs >= 3 and not self.shells)
        shells = [(now if c[2] is None else min(c[2], now)) - c[1] for c in self.conns.values() if c[1] is not None]
        out["pty.interactive"] = "pty", -15 * (max(shells, default=0) > SPAN)
        for k, (clue, weight, least) in enumerate(self.rules.styles):
            out[clue] = "style", weight * (self.styles[k] >= least)
        live = self.processes.values()
        out["proc.agent_name"] = "process", 45 * any(p[0] for p in live)
        out["proc.agent_env"] = "process", 40 * any(p[1] for p in live)
        out["proc.skip_flags"] = "flags", 25 * any(p[2] for p in live)
        out["net.ai_api"] = "network", 30 * (True in self.services)
        out["net.ai_api_unattributed"] = "network", 15 * (False in self.services)
        return {k: v for k, v in out.items() if v[1]}

    def profile(self, who: list[bool]) -> int | None:
        """The first profile that the session meets so far."""
        banners = [c for c in self.conns.values() if c[3] is not None]
        for k, (least, any_of, required, _, _) in enumerate(self.rules.profiles):
            if not who[k]:
                continue
            if any_of:
                share = self.met[k] / max(1, self.texts, self.execs) if self.texts else float(any(c[5][k] for c in banners))
                if share < least:
                    continue
            if all(x in self.required or (self.rules.required[x] and any(c[6][x] for c in banners)) for x in required):
                return k
        return None

    def verdict(self, now: int, who: list[bool]) -> tuple[int, int, bool, int]:
        """(score, rank, declared, number of clues)."""
        clues, profile = self.clues(now), self.profile(who)
        hard = any(c in ("process", "flags") for c, _ in clues.values())
        cap = None
        if profile is not None:
            *_, cap, suppressed = self.rules.profiles[profile]
            covered = lambda clue, category: category not in score.PROTECTED and any(r in (category, clue) or clue.startswith(r + ".") for r in suppressed)
            clues = {k: v for k, v in clues.items() if not covered(k, v[0])}
        points, pager = dict.fromkeys(score.CAPS, 0), 0
        minus = interactive = 0
        for clue, (category, weight) in clues.items():
            if weight < 0:
                minus, interactive = (minus, weight) if clue == "pty.interactive" else (minus + weight, interactive)
            elif clue.startswith("style.pager_guard."):
                pager += weight
            else:
                points[category] += weight
        points["style"] += min(pager, score.PAGER_CAP)
        capped = {c: min(v, score.CAPS[c]) for c, v in points.items()}
        total = max(0, min(100, sum(capped.values()) + minus + (0 if points["process"] > 0 else interactive)))
        if cap is not None and not hard:
            total = min(total, cap)
        info, alert, high = self.rules.thresholds
        rank = 3 if total >= high else 2 if total >= alert else 1 if total >= info else 0
        if rank >= 2 and sum(v > 0 for v in capped.values()) < 2:
            rank = 1
        declared = self.declared
        return total, max(rank, 1) if declared else rank, declared, len(clues)


def verdicts(rows: DataFrame, pack: Pack, thresholds: tuple[int, int, int] = (score.INFO, score.ALERT, score.HIGH)) -> DataFrame:
    """(host, user, fp, src_ip, session_start, us, seq, score, rank, declared, clues) right after each row of correlate.contents().

    One shuffle by session; a task holds the running figures of one session and no rows of it, so that a session's
    length does not matter (but for two heaps of its gaps of up to a minute). An empty rows gives no verdict.
    """
    rules = Rules.of(pack, thresholds)
    key = [*TRACK, "us", "seq"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, session = None, None
        for batch in batches:
            batch["conn"] = batch["conn"].astype(object).where(batch["conn"].notna(), None)
            for c in ("banner", "said", "marked"):
                batch[c] = batch[c].astype(object).where(batch[c].notna(), None)
            out = []
            for r in batch.itertuples(index=False):
                k = (r.host, r.user, r.fp, r.src_ip, r.session_start)
                if k != own:
                    own, session = k, Session(rules)
                session.add(r)
                out.append((*k, r.us, r.seq, *session.verdict(int(r.us), r.who)))
            yield pd.DataFrame(out, columns=[*key, "score", "rank", "declared", "clues"])

    dealt = facts(rows, pack).repartition(*TRACK).sortWithinPartitions(*key)
    return dealt.mapInPandas(fold, "host string, user string, fp string, src_ip string, session_start long, us long, seq long, score int, rank int, declared boolean, clues int")
