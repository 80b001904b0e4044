"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.sources.tables import shared_folder, stored

__all__ = ["SPACE", "crc32_mod", "documents", "join_by_group", "named", "row_named", "shared_folder", "stored", "text_or_empty"]

#: ASCII white space, [\x20\x09-\x0D], as it stands in every contract here.
SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_named(df: DataFrame, *cols: Column) -> DataFrame:
    """`cols` of df (all, if none are given) and _row, a name of its own for each row, as ids may be null or shared.

    The name is the row's file, by 64 bits of its whole path, and its place there, so that it is the same in every job
    that reads df. Rows that come from no file, or from several sources, are written first.
    """
    cols = cols or ("*",)
    try:
        return df.select(*cols, F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string")).alias("_row"))
    except AnalysisException:
        return stored(df.select(*cols, F.monotonically_increasing_id().cast("string").alias("_row")), "named-rows")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(named(col), F.lit(""))


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, parts: int = 256) -> DataFrame:
    """rows with the columns of their group (null where groups has none), for groups of any size.

    groups has one row for each key, and the number of its rows in `size`; total is the sum of the sizes, or more. Groups
    with over 1/parts of all rows are fewer than `parts`, which bounds what is broadcast; any other group is at most that
    share of a shuffle. With a total that is too small more is broadcast, but no group is left out.
    """
    floor = max(1, total // parts)
    heavy = groups.filter(F.col(size) > floor)  # fewer than parts + 1 by the pigeonhole principle
    light = groups.filter(F.col(size) <= floor)
    apart = rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return apart.unionByName(rest)
