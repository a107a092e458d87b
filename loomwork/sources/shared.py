"""Tables in the folder that driver and executors share, and the check before a broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast: a request's queries, gold or rules.
MOST_BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the shared folder's owner clears it
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/loomwork-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast, if a count shows that it has MOST_BROADCAST_ROWS at most; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS else df


@contextmanager
def text_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While this is open, jobs hand rows to Python in Arrow batches of `size` at most, as whole texts are long; then as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
