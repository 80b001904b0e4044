import random

from pyspark.sql import functions as F

from tallyhound.operators.rhythm import peak


def test_peak_against_brute_force(spark):
    rnd = random.Random(1)
    data = [(sorted(rnd.randint(0, rnd.choice([20, 300])) for _ in range(rnd.randint(0, 40))),) for _ in range(500)] + [(None,), ([],)]
    for r in spark.createDataFrame(data, "t array<bigint>").select("t", peak(F.col("t"), 17).alias("peak")).collect():
        assert r.peak == max((sum(u - 17 <= x <= u for x in r.t) for u in r.t or []), default=0)
