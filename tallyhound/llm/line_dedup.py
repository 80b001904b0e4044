"""Removal of lines that many documents hold, over levelled sorted runs of line hashes.

The index is a folder of runs. A run holds the hashes of the lines of some consecutive batches, each with the number of
documents that hold it, as a table bucketed and sorted by the hash. A new batch is counted, anti-joined with what the
runs already hold often enough (only the batch is shuffled; the runs lie in the order that the join needs), and what is
left becomes a run of level 0. Once a level has `fanout` runs they are merged into one of the next level. A run is named
by the batches it covers, so that an index whose job was lost can be opened again: a merged run hides what it was made of.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import SPACE, documents, named, row_named, shared_folder, stored, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def line_hash(line: Column) -> Column:
    """128 bits of the line's key as (h, g); null where the key is empty."""
    key = line_key(line)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))


@dataclass(frozen=True)
class Run:
    level: int
    first: int  # batches covered, the last one included
    last: int
    table: str
    path: str


class LineRuns:
    """An index of line hashes in `folder`, which all executors can read.

    `parts` is the number of buckets of each run; it should grow with the corpus, as the number of shuffle partitions
    does, which is its default. `least` is the number of documents from which on a line is frequent.
    """

    def __init__(self, spark: SparkSession, folder: str, *, least: int = 10, fanout: int = 2, parts: int | None = None):
        self.spark, self.folder, self.least, self.fanout = spark, folder.rstrip("/"), least, fanout
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, *, least: int = 10, fanout: int = 2) -> LineRuns:
        """The index as its last whole run left it; runs that were not finished, or are covered by a merged one, are not used."""
        index = cls(spark, folder, least=least, fanout=fanout)
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.folder)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in files.listStatus(root) if files.exists(root) else []:
            path = status.getPath()
            if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                level, first, last, parts = map(int, path.getName().removeprefix("run-").split("-")[:4])
                found.append((level, first, last, parts, path.toString()))
        for level, first, last, parts, path in sorted(found, key=lambda r: (r[1], -r[2], -r[0])):
            if all(last > r.last for r in index.runs):
                index.parts, table = parts, index._table()
                spark.sql(
                    f"CREATE TABLE {table} (h BIGINT, g BIGINT, n BIGINT) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {parts} BUCKETS LOCATION '{path}'"
                )
                index.runs.append(Run(level, first, last, table, path))
        return index

    @staticmethod
    def _table() -> str:
        return f"line_run_{uuid.uuid4().hex}"

    def _write(self, counts: DataFrame, level: int, first: int, last: int) -> Run:
        table, path = self._table(), f"{self.folder}/run-{level}-{first}-{last}-{self.parts}-{uuid.uuid4().hex[:8]}"
        spread = counts.select("h", "g", "n").repartition(self.parts, "h", "g")
        spread.write.format("parquet").bucketBy(self.parts, "h", "g").sortBy("h", "g").option("path", path).saveAsTable(table)
        return Run(level, first, last, table, path)

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: keys has one row (h, g) for each document and key in it.

        Counts of such keys need no more adding up, so they stay out of the new run: a run's n is the number of
        documents of its own batches for any key that no earlier run holds `least` times.
        """
        batch = 1 + max((r.last for r in self.runs), default=-1)
        counts = keys.groupBy("h", "g").agg(F.count("*").alias("n"))
        known = [self.spark.table(r.table).filter(F.col("n") >= self.least).select("h", "g") for r in self.runs]
        fresh = reduce(lambda left, run: left.join(run.hint("merge"), ["h", "g"], "left_anti"), known, counts)
        self.runs.append(self._write(fresh, 0, batch, batch))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(these := [r for r in self.runs if r.level == level]) >= self.fanout:
            made = self._write(self._merged(these), level + 1, these[0].first, these[-1].last)
            self.runs = sorted([*(r for r in self.runs if r.level != level), made], key=lambda r: r.first)
            for r in these:  # the merged run is whole by now
                self._drop(r, files=True)
            level += 1

    def _merged(self, runs: list[Run]) -> DataFrame:
        """(h, g, n) of several runs, by merge joins. (Spark 4.1 groups a union of bucketed tables as if its parts were one table's, so no union here.)"""

        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            right = right.withColumnRenamed("n", "m").hint("merge")
            return left.join(right, ["h", "g"], "full").select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(both, [self.spark.table(r.table) for r in runs])

    def _drop(self, run: Run, files: bool) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")
        if files:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run.path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def frequent(self) -> DataFrame:
        """(h, g) of the keys that `least` documents or more hold, over all runs."""
        return self._merged(self.runs).filter(F.col("n") >= self.least).select("h", "g")

    def close(self, *, files: bool = False) -> None:
        """Forgets the tables; with files, removes the runs too."""
        for r in self.runs:
            self._drop(r, files)
        self.runs = []


def drop_common_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per row of df: id_col, kept_text, n_lines (before), n_dropped.

    Lines are cut at \\n; a line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of one
    code point or more that `least` rows hold lose all their lines; the others stay, joined by \\n. Each row of df is a
    document of its own, so repeated rows and rows without an id count once each. Null and empty texts are one empty
    line, which always stays; texts are read whole; other columns of df play no part, whatever their names. An empty df
    gives an empty result. The rows are dealt to `batches` batches by their place, which changes nothing in the result.
    Keys are told apart by 128 bits.
    """
    spark = df.sparkSession
    rows = row_named(df, named(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    hashed = rows.select("_row", F.transform(lines_of(F.col("text")), line_hash).alias("keys"), F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int").alias("batch"))
    path = shared_folder(spark, "hashed-lines")
    hashed.write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema("_row string, keys array<struct<h:bigint,g:bigint>>, batch int").parquet(path)

    index = LineRuns(spark, shared_folder(spark, "line-runs"), least=least, fanout=fanout)
    for batch in range(batches):
        each = hashed.filter(F.col("batch") == batch).select(F.explode(F.array_distinct("keys")).alias("key")).filter("key IS NOT NULL")
        index.add(each.select("key.h", "key.g"))
    frequent = stored(index.frequent(), "frequent-lines")
    index.close(files=True)

    # Spark sends the frequent keys to every task where their table is small; otherwise both sides are shuffled and a common line's part is split
    every = hashed.select("_row", F.posexplode("keys").alias("pos", "key")).filter("key IS NOT NULL").select("_row", "pos", "key.h", "key.g")
    gone = every.join(frequent, ["h", "g"], "left_semi").groupBy("_row").agg(F.collect_list("pos").alias("gone"))
    # by a shuffle of the texts whatever the size, so that the job is the same on small and large data
    out = rows.join(stored(gone, "dropped-lines").hint("shuffle_hash"), "_row", "left").withColumn("lines", lines_of(F.col("text")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT rid, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY rid) USING (rid)
"""
