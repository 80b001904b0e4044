"""Line removal against brute force, and the index of runs: batches, merging, reopening."""

import collections
import re

from pyspark.sql import functions as F

from tests.llm.common import frame, rows
from tallyhound.llm import line_dedup
from tallyhound.llm.common import shared_folder

EDGES = re.compile("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$")
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def key(line):
    return EDGES.sub("", line).translate(LOWER)


def brute(data, least):
    """[(id, kept text, lines, dropped)] of data, [(id, text)]."""
    held = collections.Counter(k for _, t in data for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = (
    [(i, f"own {i}\nShared LINE\n\n  shared line\t\nend {i % 4}\r\n") for i in range(12)]
    + [(20, None), (21, ""), (22, "\n"), (23, " \x0b\n\x0c"), (24, "shared line"), (25, "Ärger\närger"), (26, "Shared line")]
    + [(30, "\n".join(["shared line", "x", "end 1"] * 5000)), (31, "y" * 200_000 + "\nSHARED LINE")]
    + [(None, "shared line\nno id"), (None, "no id"), (5, "own 5"), (5, "own 5")]
)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in LINES], "doc_id long, text string, lines string, batch int").repartition(3)
    for least in (1, 3, 10):
        assert sorted((tuple(r) for r in line_dedup.drop_common_lines(df, least=least).collect()), key=str) == brute(LINES, least)


def test_batches_and_merging_change_nothing(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    frame(spark).select("doc_id", "text", "key", "n").write.parquet(path)
    df = spark.read.parquet(path)
    data = [(i, t) for i, t, *_ in rows()]
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        got = line_dedup.drop_common_lines(df, least=2, batches=batches, fanout=fanout).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(data, 2)


def test_empty_tables_and_other_names(spark):
    df = spark.createDataFrame([], "`the id` string, `a.text` string")
    assert line_dedup.drop_common_lines(df, id_col="the id", text_col="a.text").collect() == []
    df = spark.createDataFrame([("a", "p\nq"), ("b", "q")], "`the id` string, `a.text` string")
    assert sorted(map(tuple, line_dedup.drop_common_lines(df, id_col="the id", text_col="a.text", least=2).collect())) == [("a", "p", 2, 1), ("b", "", 1, 1)]


def keys(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "line string").select(line_dedup.line_hash(F.col("line")).alias("k")).select("k.*")


def test_runs_are_merged_in_levels_and_known_keys_stay_out(spark):
    index = line_dedup.LineRuns(spark, shared_folder(spark, "runs"), least=3, parts=2)
    size = lambda run: spark.table(run.table).count()
    index.add(keys(spark, "a", "a", "a", "b"))
    assert [(r.level, r.first, r.last, size(r)) for r in index.runs] == [(0, 0, 0, 2)]
    index.add(keys(spark, "a", "b", "c"))
    assert [(r.level, r.first, r.last, size(r)) for r in index.runs] == [(1, 0, 1, 3)]  # a was known: its count is three still
    index.add(keys(spark, "a", "b"))
    assert [(r.level, r.first, r.last, size(r)) for r in index.runs] == [(1, 0, 1, 3), (0, 2, 2, 1)]
    index.add(keys(spark))
    assert [(r.level, r.first, r.last) for r in index.runs] == [(2, 0, 3)]
    assert set(index.frequent().collect()) == set(keys(spark, "a", "b").collect())
    index.close(files=True)


def test_reopened_index_ignores_what_a_lost_job_left(spark):
    folder = shared_folder(spark, "runs")
    index = line_dedup.LineRuns(spark, folder, least=2, parts=3)
    index.add(keys(spark, "a", "b"))
    # a merge that was whole, while the runs it was made of are still there
    again = line_dedup.LineRuns.open(spark, folder, least=2)
    again.add(keys(spark, "a", "c"))
    index._write(spark.table(index.runs[0].table), 0, 0, 0)
    spark.createDataFrame([(1, 1, 5)], "h long, g long, n long").write.parquet(f"{folder}/run-0-2-2-3-dead")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    mark = hadoop.Path(f"{folder}/run-0-2-2-3-dead/_SUCCESS")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(mark, False)
    last = line_dedup.LineRuns.open(spark, folder, least=2)
    assert [(r.level, r.first, r.last) for r in last.runs] == [(1, 0, 1)] and last.parts == 3
    assert last.frequent().collect() == keys(spark, "a").collect()
    last.add(keys(spark, "c"))
    assert set(last.frequent().collect()) == set(keys(spark, "a", "c").collect())
