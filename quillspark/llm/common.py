"""Shared plumbing of the text operators: durable tables, Arrow settings, streamed groups.

Nothing here keeps corpus-sized state on the driver. Intermediate tables go to the folder that the
cluster names in ``spark.checkpoint.dir`` (every executor can read it), so a lost executor only costs
the tasks it was running.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.files import swept

#: Pages of 32,768 bits, 16 MB together at most, that mark which ids may have to be picked.
PAGES, PAGE_BITS = 4_096, 32_768
#: Rows in an Arrow batch sent to Python. Texts of some kB each make batches of a few MB.
ARROW_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only where that is unset and everything runs on this machine (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}"


def park(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, and what was shuffled for it goes at once."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def unpark(df: DataFrame) -> None:
    """Delete a parked table that nothing will read any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small: a worker's memory is bounded by rows times the longest text."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory to the system, so what a task or a fit took does not stay with its process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that leaves no freed memory with a worker when its task is over; workers live on between tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return work


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def likely(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows without most of those whose key is not in ids, so that few texts go through the join that decides.

    A bit stands for a hash of the key. The table of bits is of one size at most, whatever the ids are; if it is full, more rows stay.
    """
    at = F.pmod(F.xxhash64(key), F.lit(PAGES * PAGE_BITS))
    page, bit = F.floor(at / PAGE_BITS).cast("int"), at % PAGE_BITS
    pages = ids.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = rows.withColumn("page", page).withColumn("bit", bit).join(F.broadcast(pages), "page")  # PAGES rows at most
    return marked.where(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1).select(*rows.columns)


def pick(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """rows joined with dealt by doc_id: one shuffle of those rows that ``likely`` leaves, at every size."""
    return likely(rows, dealt).join(dealt.hint("merge"), "doc_id")


def streamed(key: str, work: Callable[[object, pa.Table], Iterable[pa.RecordBatch]], most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function over rows sorted by ``key``: calls ``work`` once for each key.

    Groups are bounded by those who build the keys (blocks, salted chunks), so one is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table, keys = pa.Table.from_batches([batch]), batch.column(key).to_pylist()
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if held and now != keys[at]:
                        yield from work(now, pa.concat_tables(held))
                        held = []
                    now = keys[at]
                    held.append(table.slice(at, i - at))
                    at = i
        if held:
            yield from work(now, pa.concat_tables(held))

    return run
