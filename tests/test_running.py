"""Verdicts at each event: the same as the whole session's at its end, and as those of the session so far at any moment."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import correlate, detect, running
from tallyhound.sources import rules
from tallyhound.sources.tables import stored
from tests.test_sources import SCENES

COLUMNS = "host string, t double, kind string, source string, user string, src_ip string, src_port int, pid int, ses int, fields map<string,string>"


@pytest.fixture(scope="module")
def contents(spark):
    rows = [(host, float(r[0]), *r[1:]) for host, scene in SCENES.items() for r in scene]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("ts", F.timestamp_seconds(F.lit(1789000000) + F.col("t")))
    return stored(correlate.contents(stored(df.drop("t").withColumn("seq", F.monotonically_increasing_id()), "scene-events"), gap=None)[0], "contents")


def test_each_verdict_is_that_of_the_session_so_far(spark, contents):
    pack = rules.default_pack()
    got = {(r.host, r.user, r.src_ip, r.us, r.seq): (r.score, r.rank, r.declared) for r in running.verdicts(contents, pack).collect()}
    assert len(got) == contents.count() > 100
    moments = contents.select(*correlate.SESSION, F.col("us").alias("at"), F.col("seq").alias("at_seq"))
    tracks = stored(correlate.tracks_at(contents, moments), "tracks-at")
    want = {(r.host, r.user, r.src_ip, r.at, r.at_seq): (r.score, r["rank"], r["class"] == "declared_agent") for r in detect.verdicts(tracks, pack, key=[*detect.TRACK, "at", "at_seq"]).collect()}
    assert got == want
    assert len({v[1] for v in got.values()}) >= 3 and any(v[2] for v in got.values())


def test_running_figures_of_gaps():
    rnd = random.Random(4)
    for _ in range(30):
        gaps, values = running.Gaps(cut=500), []
        for _ in range(rnd.randrange(1, 60)):
            values.append(rnd.randrange(0, 900))
            gaps.add(values[-1])
            short = [v for v in values if v <= 500]
            assert gaps.median == (math.floor(statistics.median(short)) if short else 0)
            if len(values) > 1 and sum(values):
                assert gaps.variation == pytest.approx(statistics.pstdev(values) / statistics.mean(values))
            else:
                assert gaps.variation == math.inf


def test_a_long_session_takes_one_pass(spark):
    """200,000 commands of one session."""
    base = spark.range(200_000).select(
        F.lit("h").alias("host"), F.lit("u").alias("user"), F.lit("-").alias("fp"), F.lit("local").alias("src_ip"), F.lit(0).cast("long").alias("session_start"), (F.col("id") * 700_000).alias("us"), F.col("id").alias("seq"),
        F.lit("audit.execve").alias("kind"), F.lit(5).alias("pid"), F.create_map(F.lit("cmd"), F.lit("ls")).alias("fields"), F.lit(True).alias("attributed"), F.lit(None).cast("string").alias("conn"), F.lit(None).cast("long").alias("opened"),
        F.lit("ls").alias("cmd"), F.lit("auditd").alias("origin"), F.lit("ls").alias("argv0"),
    )
    last = running.verdicts(base, rules.default_pack()).orderBy(F.desc("us")).first()
    assert (last.us, last.score, last["rank"]) == (199_999 * 700_000, 45, 1)  # burst, regular, subsecond and sustained, one category
