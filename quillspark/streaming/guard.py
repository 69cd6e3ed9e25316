"""A drift guard on a stream: a key's first fingerprint is pinned, later records with another are turned away; and an upsert that survives reruns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pins(StatefulProcessor):
    """State: the fingerprint that a key began with. Output: each record with that fingerprint and whether it agrees."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pin = handle.getValueState("pin", T.StructType([T.StructField("fingerprint", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pinned = self.pin.get()[0] if self.pin.exists() else None
        if pinned is None:
            # the earliest record of the trigger that has a fingerprint pins it; a trigger's rows are bounded by its files
            held = list(rows)
            some = pd.concat(held)[["order", "fingerprint"]].dropna()
            if len(some):
                pinned = some.sort_values(["order", "fingerprint"])["fingerprint"].iloc[0]
                self.pin.update((pinned,))
            rows = iter(held)
        for part in rows:
            yield pd.DataFrame({"key": part["key"], "id": part["id"], "fingerprint": part["fingerprint"], "pinned": pinned, "accepted": part["fingerprint"].notna() & (part["fingerprint"] == pinned)})

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """State of this kind is kept by the RocksDB provider; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.unset(_STORE[0]) if before is None else spark.conf.set(_STORE[0], before)


def guarded(log: DataFrame, key: str, record: str, fingerprint: str, order: str) -> DataFrame:
    """(key, id, fingerprint, pinned, accepted) of a stream: accepted are records with their key's first fingerprint.

    The first is the earliest by ``order`` in the first trigger that brings the key; a record without a
    fingerprint is never accepted and pins nothing. Pins outlive restarts in the checkpoint.
    """
    ship(log.sparkSession)
    rows = log.select(F.col(key).cast("string").alias("key"), F.col(record).cast("long").alias("id"), F.col(fingerprint).cast("string").alias("fingerprint"), F.col(order).cast("timestamp").alias("order"))
    return rows.groupBy("key").transformWithStateInPandas(Pins(), "key string, id long, fingerprint string, pinned string, accepted boolean", "append", "none")


def run_guarded(out: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; a later call goes on with the pins that it left."""
    with _state_store(out.sparkSession):
        q = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def upsert(stream: DataFrame, key: str, order: str, folder: str, checkpoint: str) -> None:
    """Keep the latest row of each key in ``folder``: every trigger writes the table anew under its number and a rerun trigger writes the same again.

    ``current`` reads the last whole table. Rows are latest by ``order``; of equal ones the larger row stays.
    """
    columns = [key, order, *(c for c in stream.columns if c not in (key, order))]
    latest = W.partitionBy(key).orderBy(F.desc(order), F.desc(F.struct(*columns)))

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        if number and (old := current(batch.sparkSession, folder, number)) is not None:
            rows = old.select(*columns).unionByName(rows)
        one = rows.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
        one.write.mode("overwrite").parquet(f"{folder}/v={number:012d}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The last table that was written whole (before trigger ``before``); null if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    names = [n for n in names if n.startswith("v=") and (before is None or int(n[2:]) < before)]
    return spark.read.parquet(f"{folder}/{names[-1]}") if names else None
