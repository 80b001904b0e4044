"""op2's rows come from shards that were written, rewritten where they change, and read back."""

from pathlib import Path

from pyspark.sql import functions as F

from tallyhound.llm import reshard


def test_rows_are_read_from_rewritten_shards(spark, monkeypatch):
    written, before = [], reshard.rewrite_affected

    def seen(rows, plan, folders, path, **more):
        written.append((dict(folders), before(rows, plan, folders, path, **more)))
        return written[-1][1]

    monkeypatch.setattr(reshard, "rewrite_affected", seen)
    docs = spark.createDataFrame([(k % 90, None if k == 5 else f"text {k}" * (k % 7), "a" if k % 3 else "b") for k in range(100)], "doc_id long, text string, source string")
    got = reshard.resharded(spark, docs, F.when(F.col("source") == "a", 3).otherwise(20)).collect()
    (old, new), = written
    assert set(old) == {3, 20} and set(new) == set(range(16)) and not set(old.values()) & set(new.values())
    want = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("c"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).collect()
    assert sorted((r.doc_id, r.text_crc32, r["size"]) for r in got) == sorted(tuple(r) for r in want)
    assert sorted((r.shard, r.slot) for r in got) == sorted((k % 16, k // 16) for k in range(100))
    assert reshard.resharded(spark, docs.limit(0), F.lit(0)).count() == 0


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_are_shuffled_once_and_shards_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reshard, "shared_folder", lambda _, name: str(tmp_path / name))
    digits = F.concat(*[F.sha2((F.col("id") * 97 + k).cast("string"), 256) for k in range(40)])  # half a byte of news in each
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), digits.alias("text"))
    texts, before = 2000 * 40 * 64, shuffled_bytes(spark)
    got = reshard.resharded(spark, docs, F.col("doc_id") % 3)
    assert 0.9 * texts < shuffled_bytes(spark) - before < 1.5 * texts
    for name in ("old-shards", "new-shards"):
        assert sum(p.stat().st_size for p in Path(tmp_path, name).rglob("*.parquet")) < 0.8 * texts
    assert sorted((r.shard, r.slot) for r in got.collect()) == sorted((k % 16, k // 16) for k in range(2000))


def test_files_hold_rows_by_slot_and_few_enough(spark, tmp_path):
    rows = reshard.keyed(spark.range(600).select(F.col("id").alias("i")))
    plan = reshard.reshard(rows.select("_row"), old_shard=F.lit(7), size=F.lit(3), shards=4).cache()
    new = reshard.rewrite_affected(rows, plan, {7: str(tmp_path / "old")}, str(tmp_path / "new"), file_rows=20)
    slots = {r.i: (r.shard, r.slot) for r in rows.join(plan, "_row").collect()}
    files = [(k, [r.i for r in spark.read.parquet(str(p)).coalesce(1).collect()]) for k, folder in new.items() for p in Path(folder).glob("*.parquet")]
    assert sorted(i for _, held in files for i in held) == list(range(600))
    assert all(len(held) <= 20 and [slots[i] for i in held] == sorted((k, slots[i][1]) for i in held) for k, held in files)
