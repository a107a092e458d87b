"""Tables of rows by key that are written in place: replaced, or counted up, batch by batch.

A table is a folder of data files by key bucket and a log. A write reads and rewrites the buckets that its keys touch
and no others, into a folder of its own, then adds a log entry that says where each bucket is now. A reader sees the
last whole entry, so a write that fails leaves the table as it was. An entry keeps the number of the last batch of each
source, and a batch that is written again changes nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.shared import stored


class KeyedTable:
    """One writer at a time. Keys are compared null-safe; rows of a write are first brought to one a key, so a hot key is one row.
    A bucket is written by one task, so there should be as many as make one fit a task; the number stays with the table."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.columns = spark.createDataFrame([], schema).schema
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{folder}/{name}")
        self._fs = self._path("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _entries(self) -> list[str]:
        if not self._fs.exists(self._path("log")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("log"))]
        return sorted(x for x in names if x.endswith(".json"))

    def _state(self) -> dict:
        """buckets: the folder of each bucket that has one; batches: the last batch of each source."""
        names = self._entries()
        if not names:
            return {"buckets": {}, "batches": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/log/{names[-1]}", wholetext=True).collect()))  # a line a bucket

    def _commit(self, state: dict) -> None:
        name = f"{len(self._entries()):010d}.json"
        draft = self._path(f"log/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._path(f"log/{name}")):
            raise RuntimeError(f"{self.folder}: entry {name} was written by another")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        chosen = {k: v for k, v in state["buckets"].items() if buckets is None or int(k) in buckets}
        if not chosen:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(*sorted(f"{self.folder}/{v}/_bucket={k}" for k, v in chosen.items()))

    def read(self) -> DataFrame:
        return self._read(self._state())

    def _write(self, incoming: DataFrame, combined: list[Column], batch: tuple[str, int] | None) -> bool:
        """combined: each column from `old` and `new` rows. False if the batch has been written before."""
        state = self._state()
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        new = stored(incoming.withColumn("_bucket", self._bucket()), "write")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
        if touched:
            old = self._read(state, touched)
            same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.key]
            both = old.withColumn("_there", F.lit(True)).alias("old").join(new.alias("new"), same, "full")
            rows = both.select(*combined).withColumn("_bucket", self._bucket())
            name = f"data-{uuid.uuid4().hex}"
            rows.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
            state["buckets"] |= {str(b): name for b in touched}
        if batch is not None:
            state["batches"][batch[0]] = batch[1]
        if touched or batch is not None:
            self._commit(state)
        return True

    def replace(self, rows: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> bool:
        """The row of each key that is last in `order` takes the place of the table's, unless that is later. batch: source and number."""
        fields = self.columns.names
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r")).select("r.*")
        at = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in order))
        stays = F.col("_there").isNotNull() & (F.col("new._bucket").isNull() | (at("old") > at("new")))
        return self._write(last, [F.when(stays, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in fields], batch)

    def count_up(self, rows: DataFrame, counters: list[str], batch: tuple[str, int] | None = None) -> bool:
        """The counters of each key's rows are added to the table's; a key that is not there starts at 0. Other columns are those of the last write."""
        others = [c for c in self.columns.names if c not in (*self.key, *counters)]
        one = rows.groupBy(*self.key).agg(*(F.sum(c).alias(c) for c in counters), *(F.max(c).alias(c) for c in others)).select(self.columns.names)
        seen = F.col("new._bucket").isNotNull()
        added = lambda c: (F.coalesce(f"old.{c}", F.lit(0)) + F.coalesce(f"new.{c}", F.lit(0))).cast(self.columns[c].dataType)
        take = lambda c: F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        return self._write(one, [(added(c) if c in counters else take(c)).alias(c) for c in self.columns.names], batch)


def run_into(stream: DataFrame, name: str, checkpoint: str, write) -> None:
    """Runs a stream over what its source holds now; write(rows, (name, number)) gets each micro-batch with its number, so that one
    which is run again after a failure is known by the table."""
    run = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    run.foreachBatch(lambda rows, number: write(rows, (name, number))).start().awaitTermination()
