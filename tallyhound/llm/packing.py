"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are dealt at random into cells of bounded size, whose number grows with the data; each cell is packed on its
own. Its bins stand ordered by what is left in them. Each bin carries a bitmap of the sources and one of the duplicate
clusters in it. A document, the longest first, starts at the tightest bin that it fits and goes on to each successor
until one has room for its source and lacks its cluster; without one it opens a new bin. No bin holds two texts of one
cluster, nor more than `per_source` documents of one source.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import documents, stored, text_or_empty

#: Words in a sequence, documents of one source in a bin, pieces in a cell.
CAPACITY, PER_SOURCE, CELL = 4096, 4, 2000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, taken in the order given. sources and clusters number the cell's own, for the bitmaps."""
    bins: list[tuple[int, int]] = []  # (space left, bin), in order
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        first, one = source * per_source, 1 << cluster
        room = ((1 << per_source) - 1) << first
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (cluster_bits[bins[at][1]] & one or source_bits[bins[at][1]] & room == room):
            at += 1
        if at < len(bins):
            left, k = bins.pop(at)
        else:
            left, k = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        used = (source_bits[k] & room) >> first
        source_bits[k] |= 1 << (first + used.bit_length())
        cluster_bits[k] |= one
        out.append((k, capacity - left))
        insort(bins, (left - size, k))
    return out


def pack(df: DataFrame, *, size: Column, cluster: Column, source: Column, id_col: str = "doc_id", capacity: int = CAPACITY, per_source: int = PER_SOURCE, cell: int = CELL) -> DataFrame:
    """One row per piece: id_col, piece, pieces, size, bin, offset.

    A document longer than a sequence is cut: its full pieces are bins of their own, the rest is packed like any other
    document. Documents of size 0 (null, empty, blank) have one piece of size 0. A null source is one source. Repeated rows
    each get a place. bin is the same string for all that share a sequence. Extra columns of df are ignored; an empty df
    gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), size.cast("long").alias("total"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), cluster.cast("long").alias("cluster"))
    rows = stored(rows, "packing-items")
    cells = max(1, -(-rows.count() // cell))
    rest = F.when(F.col("total") > 0, F.pmod(F.col("total") - 1, F.lit(capacity)) + 1).otherwise(F.lit(0))
    rows = rows.withColumn("rest", rest).withColumn("pieces", (F.when(F.col("total") > 0, F.ceil(F.col("total") / capacity)).otherwise(F.lit(1))).cast("int"))
    full = rows.filter("pieces > 1").withColumn("row", F.monotonically_increasing_id()).select("doc_id", F.explode(F.expr("sequence(0, pieces - 2)")).alias("piece"), "pieces", F.lit(capacity).cast("long").alias("size"), "row")
    full = full.select("doc_id", "piece", "pieces", "size", F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin"), F.lit(0).cast("long").alias("offset"))
    # dealt by their place as well, so that rows without an id and of one text do not share a cell
    items = rows.withColumn("_place", F.monotonically_increasing_id()).withColumn("cell", F.pmod(F.xxhash64("doc_id", "cluster", "_place"), F.lit(cells))).repartition("cell").sortWithinPartitions("cell", F.desc("rest"), "doc_id", "cluster", "source")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(own: pd.DataFrame) -> pd.DataFrame:
            numbers = [pd.factorize(own[c])[0].tolist() for c in ("source", "cluster")]
            places = best_fit(own["rest"].tolist(), *numbers, capacity, per_source)
            return own.assign(piece=own["pieces"] - 1, size=own["rest"], bin=[f"{c}-{k}" for c, (k, _) in zip(own["cell"], places)], offset=[o for _, o in places])[["doc_id", "piece", "pieces", "size", "bin", "offset"]]

        waiting: list[pd.DataFrame] = []
        for batch in batches:
            for number, own in batch.groupby("cell", sort=False):
                if waiting and waiting[0]["cell"].iloc[0] != number:
                    yield packed(pd.concat(waiting, ignore_index=True))
                    waiting = []
                waiting.append(own)
        if waiting:
            yield packed(pd.concat(waiting, ignore_index=True))

    small = items.select("doc_id", "source", "cluster", "rest", "pieces", "cell").mapInPandas(run, f"doc_id {kind}, piece int, pieces int, size long, bin string, offset long")
    return small.unionByName(full).withColumnRenamed("doc_id", id_col)


def words_in(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in a text."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))


def packed_documents(df: DataFrame, **options) -> DataFrame:
    """pack() with a document's words as its size and equal texts as its duplicate cluster."""
    text = text_or_empty()
    return pack(df, size=words_in(text), cluster=F.xxhash64(text), source=F.col("source"), **options)


def op5_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
