from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhound.functions import cron, text
from tallyhound.operators import policy, rhythm, score
from tallyhound.operators.sessions import sessionised, sessionised_split


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, text.sanitised(lit("a\x1b[31mred\x1b[0m\x07b\x1b]0;t\x07c"), 64)) == "ared?bc"
    assert one(spark, text.cleaned(lit("  a\n\tb \x01 c  "))) == "a b c"
    assert one(spark, text.fragment(lit("ls -la"), lit(" ; && cd x"))) == "cd x"
    assert one(spark, text.fragment(lit("  ls -la"), lit(""))) == "ls"
    assert one(spark, text.redacted(lit("rm -rf é"), "argv0")) == "rm … (len 9)"
    assert one(spark, text.redacted(lit("rm x"), "none")) == "" and one(spark, text.redacted(lit(" rm  x"), "full")) == "rm x"
    assert one(spark, text.declared(lit("a b"))) == "invalid-declaration" and one(spark, text.declared(lit("x@1.2"))) == "x@1.2"
    assert one(spark, text.declared_name(lit(" Agent@2"))) == "agent"
    for said, inner in {"/bin/bash -c cd x && y": "cd x && y", "-bash -c ls": "ls", "fish -c ls": "ls", "bash -lc ls": "bash -lc ls", "csh -c ls": "csh -c ls", "sh x -c ls": "sh x -c ls"}.items():
        assert one(spark, text.shell_command(lit(said))) == inner
    assert one(spark, text.sanitised(lit("aéé"), 4)) == "aé" and one(spark, text.first_bytes(lit("𝒳𝒳"), 7)) == "𝒳" and one(spark, text.fragment(lit(""), lit("ééé"), 5)) == "éé…"
    assert [one(spark, text.ip6_hex(lit(x))) for x in ("::1", "2001:db8::a:0:1", "1:2:3:4:5:6:7:8", "1::2::3", "1.2.3.4")] == ["0" * 31 + "1", "20010db80000000000000000000a00000001"[:8] + "0" * 12 + "000a00000001", "00010002000300040005000600070008", None, None]
    assert [one(spark, text.ip_in_cidr(lit(x), c)) for x, c in [("2001:db8:1::5", "2001:db8::/32"), ("2001:db9::", "2001:db8::/32"), ("10.1.2.3", "10.0.0.0/8"), ("10.1.2.3", "::/0"), ("::1", "::1")]] == [True, False, True, False, True]
    assert [one(spark, text.duration_said(lit(x * 1000).cast("long"))) for x in (250, 1500, 2000, 125_000, 3_610_000)] == ["250ms", "1.5s", "2s", "2m5s", "1h0m10s"]
    assert one(spark, text.base_name(lit("/usr/bin/x (deleted)"))) == "x"
    assert [one(spark, text.host_matches(lit(h), r)) for h, r in [("API.x.ai.", "x.ai"), ("ax.ai", "x.ai"), ("a.openai.azure.com", "*.openai.azure.com")]] == [True, False, True]
    assert one(spark, text.ip_number(lit("::ffff:1.2.3.4"))) == 0x01020304 and one(spark, text.ip_number(lit("1.2.3"))) is None
    assert one(spark, text.in_cidr(text.ip_number(lit("10.1.2.3")), "10.0.0.0/8"))
    assert one(spark, text.joined_evidence(F.array(*map(F.lit, "abcde")))) == "a; b; c +2 more"
    assert one(spark, text.slack_escaped(lit("<a&b>"))) == "&lt;a&amp;b&gt;"


def test_cron():
    c = cron.parse("*/15 9-17 * * mon-fri")
    assert c.matches(datetime(2026, 9, 14, 9, 30)) and not c.matches(datetime(2026, 9, 13, 9, 30))
    assert c.next(datetime(2026, 9, 11, 17, 50)) == datetime(2026, 9, 14, 9, 0)
    assert c.prev(datetime(2026, 9, 14, 8, 0)) == datetime(2026, 9, 11, 17, 45)
    either = cron.parse("0 0 13 * fri")  # the thirteenth, or any Friday
    assert either.matches(datetime(2026, 9, 13)) and either.matches(datetime(2026, 9, 11)) and not either.matches(datetime(2026, 9, 12))
    assert cron.parse("@weekly").weekday == frozenset({0}) and cron.parse("0 0 * * 7").weekday == frozenset({0})
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            cron.parse(bad)


def test_rhythm(spark):
    times = F.array(*[F.lit(x).cast("long") for x in (0, 100, 250, 300, 460)])
    assert one(spark, rhythm.deduped(times, 200)) == [0, 250, 460]
    assert one(spark, rhythm.median(F.array(*[F.lit(x).cast("long") for x in (1, 2, 4, 10)]))) == 3
    assert one(spark, rhythm.peak(times, 200)) == 3
    assert one(spark, rhythm.variation(F.array(F.lit(5).cast("long")))) == float("inf")


def test_split_sessions_are_the_same(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("u"), (F.pmod(F.xxhash64("id"), F.lit(10**6))).alias("us"), F.col("id").alias("seq"))
    a, b = (f(df, key=["u"], gap=900, **k) for f, k in ((sessionised, {}), (sessionised_split, {"span": 5000})))
    assert a.select("seq", "session_start").exceptAll(b.select("seq", "session_start")).count() == 0


def verdict_frame(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "s string, us long, seq long, rank int, declared boolean, freeze string, until long")


def test_policy(spark):
    minute = 60_000_000
    seq = verdict_frame(spark, [(k * minute, k, r, False, "", 0) for k, r in enumerate([0, 1, 2, 3, 3])])
    assert [r.event for r in policy.alerts(seq, key=["s"]).orderBy("us").collect()] == ["info", "agent_detected", "agent_high"]
    steady = verdict_frame(spark, [(k * 10 * minute, k, 2, False, "", 0) for k in range(10)])
    assert [r.event for r in policy.alerts(steady, key=["s"]).orderBy("us").collect()] == ["agent_detected"] + ["agent_still_active"] * 3
    frozen = verdict_frame(spark, [(0, 0, 1, False, "f", 9), (minute, 1, 1, False, "f", 9), (2 * minute, 2, 2, False, "f", 9), (3 * minute, 3, 1, False, "g", 9)])
    assert [r.event for r in policy.alerts(frozen, key=["s"]).orderBy("us").collect()] == ["freeze_violation", "agent_detected", "freeze_violation"]
    said = verdict_frame(spark, [(0, 0, 1, True, "", 0), (minute, 1, 1, True, "", 0), (2 * minute, 2, 3, True, "", 0)])
    assert [r.event for r in policy.alerts(said, key=["s"]).orderBy("us").collect()] == ["agent_declared", "agent_high"]


def test_score(spark):
    clues = spark.createDataFrame(
        [("a", "banner.library", "banner", 35, False, ""), ("a", "rhythm.burst", "rhythm", 20, False, ""), ("b", "rhythm.burst", "rhythm", 80, False, ""), ("c", "style.pager_guard.head", "style", 5, False, ""), ("c", "style.pager_guard.tail", "style", 5, False, ""),
         ("c", "style.pager_guard.sed_range", "style", 5, False, ""), ("c", "style.pager_guard.timeout", "style", 5, False, ""), ("d", "proc.agent_name", "process", 45, True, ""), ("d", "pty.interactive", "pty", -15, False, "x"), ("e", "rhythm.burst", "rhythm", 20, True, "")],
        "k string, clue string, category string, weight int, suppressed boolean, declared string",
    )
    got = {r.k: r for r in score.verdicts(clues, key=["k"], thresholds=(40, 50, 90)).collect()}
    assert (got["a"].score, got["a"].level, got["a"]["class"]) == (55, "alert", "suspected_agent")
    assert (got["b"].score, got["b"].categories) == (45, 1) and got["c"].score == 15
    assert (got["d"].score, got["d"]["class"], got["d"].level) == (45, "declared_agent", "info") and "e" not in got
