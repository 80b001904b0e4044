"""Sketches against exact counts on skewed rows, and a stream of windows against the batch."""

from pyspark.sql import functions as F

from tallyhound.operators import sketches
from tallyhound.streaming import live


def test_error_bound_on_a_skewed_stream(spark):
    rows = spark.range(200_000).select(F.floor(20_000 * F.pow((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) + 1) / 1_000_000, 6)).cast("long").alias("ip"), (F.col("id") % 4).alias("part"))
    exact = {r.ip: r["count"] for r in rows.groupBy("ip").count().collect()}
    parts = sketches.frequencies(rows, "ip", "part", tracked=256)
    got = {r.item: r["count"] for r in sketches.heaviest(parts, 100, tracked=256).collect()}
    limit = sketches.bound(200_000, 256)
    assert len(exact) > 5000 and limit < 1400 and all(abs(exact[i] - n) <= limit for i, n in got.items())
    assert {i for i, n in exact.items() if n > limit} <= set(got) and sum(n > limit for n in exact.values()) >= 3
    assert [(r.item, r["count"]) for r in sketches.heaviest(sketches.frequencies(rows.limit(0).unionByName(spark.createDataFrame([(None, 1), (7, 1), (7, 2)], "ip long, part long")), "ip", "part"), 3).collect()] == [(7, 2)]


def test_streamed_windows_are_the_batch_ones(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 7).alias("user"), F.pmod(F.xxhash64("id"), F.lit(6)).alias("host"), F.timestamp_seconds(F.lit(1789000000) + F.col("id") * 11).alias("ts"))
    hops = lambda df, **k: sketches.distinct_in_hops(df, key="user", what="host", span="20 minutes", hop="5 minutes", **k)
    want = sorted(tuple(r) for r in sketches.on_many(hops(rows), 5).collect())
    end = rows.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    for part in (rows.filter("ts < timestamp_seconds(1789010000)"), rows.filter("ts >= timestamp_seconds(1789010000)"), end):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = hops(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="1 minute")
        live.run_once(sketches.on_many(stream, 5), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want and len(want) > 100
