"""Media within a binary column, and packing cells of rows that look alike."""

from pyspark.sql import functions as F

from tallyhound.llm import media_sniff, packing


def test_media_of_a_binary_column(spark):
    a, b, c = media_sniff.wav(b"\x01" * 576), media_sniff.png(b"\x07" * 576), media_sniff.bmp(b"\x09" * 576)
    blobs = [b"head" + a + b"--" + b + c, a[:-5], b"RIFFxxxxWAVE nothing", b"", None, c, c]
    declared = ["audio/wav", "audio/wav", None, "image/png", "x", "image/png", None]
    df = spark.createDataFrame(list(zip(range(7), blobs, declared)), "`start` int, `the blob` binary, type string")
    got = {r.start: r.media for r in media_sniff.sniffed(df, blob_col="the blob", declared_col="type").collect()}
    assert [(m.start, m.length, m.type, m.corrected, bytes(m.bytes)) for m in got[0]] == [(4, len(a), "audio/wav", False, a), (6 + len(a), len(b), "image/png", True, b), (6 + len(a) + len(b), len(c), "image/bmp", True, c)]
    assert [got[k] for k in (1, 2, 3, 4)] == [[]] * 4
    assert [(m.type, m.corrected) for m in got[5]] == [("image/bmp", True)] and [(m.type, m.corrected) for m in got[6]] == [("image/bmp", None)]
    assert media_sniff.sniffed(df.limit(0), blob_col="the blob").collect() == []
    assert media_sniff.recover("audio/wav", b"no medium") == (b"", "none;declared audio/wav;hits 0;media 0")


def test_rows_without_an_id_are_dealt_to_many_cells(spark):
    df = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"), F.lit("s").alias("source"))
    got = packing.packed_documents(df).groupBy(F.substring_index("bin", "-", 1).alias("cell")).count().collect()
    assert len(got) == 3 and sum(r["count"] for r in got) == 6000 and max(r["count"] for r in got) < 2400
