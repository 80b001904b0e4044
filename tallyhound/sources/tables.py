"""Tables that jobs write between their steps, under the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Folders of the tables that were stored within the step that is under way, in this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Rows that go to a Python worker at once while a table is made. Spark's own 10000 are meant for narrow rows; with whole
#: texts they are tens of megabytes, several times over, in each worker and outside the JVM's heap.
BATCH_ROWS = 2000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are stored within, at its end, also after an error: for steps whose result is stored outside."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which every executor can read.

    Where that setting is absent a session on one machine (local[...]) gets a temporary folder. On a cluster that is an
    error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later stages no longer depend on how it was made."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    if (made := _made.get()) is not None:
        made.append(path)
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    return spark.read.schema(df.schema).parquet(path)
