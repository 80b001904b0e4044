"""A detector of one's own adds clues that count like the others."""

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import correlate, detect
from tallyhound.sources import rules
from tallyhound.sources.tables import stored
from tests.test_sources import event, login

COLUMNS = "t double, kind string, source string, user string, src_ip string, src_port int, pid int, ses int, fields map<string,string>"


def test_a_detector_of_ones_own(spark):
    rows = [login(0, "ann", "10.0.0.3", 900, 50), login(0, "bob", "10.0.0.4", 901, 60)] + [event(10.0 + k, "audit.execve", u, pid=100 + k, cmd=c) for k, (u, c) in enumerate([("ann", "curl x"), ("ann", "curl y"), ("bob", "ls")])]
    df = spark.createDataFrame([(float(r[0]), *r[1:]) for r in rows], COLUMNS).withColumn("ts", F.timestamp_seconds(F.lit(1789000000) + F.col("t"))).drop("t")
    tracks = stored(correlate.tracks(df), "tracks")

    def downloads():
        hits = F.filter("commands", lambda c: c["cmd"].startswith("curl "))
        yield "style.downloads", "style", F.when(F.size(hits) >= 2, 12), F.format_string("%d downloads", F.size(hits))
        yield "network.odd", "network", F.lit(0), F.lit("never")

    got = {r.user: r for r in detect.verdicts(tracks, rules.default_pack(), detectors=[downloads]).collect()}
    assert (got["ann"].score, got["ann"].evidence["style.downloads"]) == (12, "2 downloads") and got["bob"].score == 0 and "network.odd" not in got["ann"].reasons
    for bad in (("style.x", "fashion"), ("style.heredoc", "style")):
        with pytest.raises(ValueError, match=bad[0]):
            detect.clues(tracks, rules.default_pack(), detectors=[lambda bad=bad: [(*bad, F.lit(1), F.lit(""))]])
