"""Sources and sinks: typed readers, canonical JSON, append-only logs, locked inputs, atomic publishing."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Bytes of files that are one row each, and those of larger files that are held at a time.
WHOLE, PIECE = 64 << 20, 4 << 20
#: Spark's setting for shuffle files that go with the query they were made for.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _open(uri: str):
    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":
        return open("/" + (rest or uri).lstrip("/"), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); a temporary one only where all runs on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quill-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of tables written in this block go when the write is over, not when the driver happens to collect its garbage."""
    old = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if old is None else spark.conf.set(SWEEP, old)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = True) -> DataFrame:
    """JSON Lines or whole JSON documents with a declared schema; malformed records fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def read_json_split(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good records, malformed lines): the dead-letter form of ``read_json``."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    kept = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    x = raw.withColumn("r", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return x.where(~bad).select("r.*").drop("_bad"), x.where(bad).select(F.col("value").alias("line"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_vectors(spark: SparkSession, path: str, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector array<double>): vectors are keyed by id, never by position."""
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vector"))


def canonical_json(df: DataFrame) -> DataFrame:
    """One line a row with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    canonical_json(df).write.mode(mode).text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header in the given column order."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, md5) of whole files.

    A digest is one chain, so a file is read by one task. Spark reads files of up to ``WHOLE`` bytes, from any
    store; larger ones are opened by the task and read in pieces, whatever their size (as in ``blocks``).
    """
    ship(spark)
    f = spark.read.format("binaryFile").load(path)
    small = f.where(F.col("length") <= WHOLE).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    large = f.where(F.col("length") > WHOLE).select("path", "length")  # contents are not read
    piece = PIECE

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                sha, md5, n = hashlib.sha256(), hashlib.md5(usedforsecurity=False), 0
                with _open(name) as f:
                    while data := f.read(piece):
                        sha.update(data)
                        md5.update(data)
                        n += len(data)
                if n != length:
                    raise OSError(f"{name} has changed since it was listed")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([sha.hexdigest()]), pa.array([md5.hexdigest()])], names=["path", "bytes", "sha256", "md5"])

    return small.unionByName(large.mapInArrow(read, small.schema))


def check_lock(spark: SparkSession, path: str, sha256: str, rows: int | None = None, schema: T.StructType | str | None = None) -> None:
    """Fail unless the file has this digest and, if given, so many JSON lines."""
    got = digests(spark, path).select("sha256").collect()
    if [r[0] for r in got] != [sha256]:
        raise ValueError(f"{path} does not match its lock")
    if rows is not None and (n := spark.read.text(path).where(F.trim("value") != "").count()) != rows:
        raise ValueError(f"{path} has {n} rows, its lock says {rows}")


def publish(spark: SparkSession, df: DataFrame, path: str, check=None) -> None:
    """Write to a staging path, check what was written, then swap; a failed check or swap leaves the old table."""
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs = hp(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.parquet(stage)
    try:
        if check is not None:
            bad = check(spark.read.parquet(stage))
            if bad.limit(1).count():
                raise ValueError(f"{path}: the new table has violations: {json.dumps([r.asDict() for r in bad.limit(5).collect()], default=str)}")
        had = fs.exists(hp(path))
        if had and not fs.rename(hp(path), hp(old)):
            raise OSError(f"cannot move {path}")
        if not fs.rename(hp(stage), hp(path)):
            if had:
                fs.rename(hp(old), hp(path))
            raise OSError(f"cannot publish {path}")
        if had:
            fs.delete(hp(old), True)
    finally:
        if fs.exists(hp(stage)):
            fs.delete(hp(stage), True)


def write_json_document(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A bounded result as one JSON document: keys in order, two blanks of indent, a line end at the end; more than ``most`` rows are refused."""
    rows = [r[0] for r in canonical_json(df).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a document holds {most} rows at most; write JSON lines")
    text = json.dumps([json.loads(r) for r in rows], indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_dead_letters(bad: DataFrame, path: str, stage: str) -> int:
    """Append rows that failed, with the stage they failed in; returns how many. Spark's commit keeps writers apart."""
    rows = bad.select(F.lit(stage).alias("stage"), F.to_json(F.struct(*sorted(bad.columns))).alias("record"))
    rows.write.mode("append").json(path)
    return bad.count()


def write_vectors(df: DataFrame, path: str, id_col: str, vec_col: str) -> DataFrame:
    """Write (id, vector) and read it back, so that what is searched is what is stored: ids and vectors stay in one row."""
    df.select(F.col(id_col).alias(id_col), F.transform(vec_col, lambda x: x.cast("float")).alias(vec_col)).write.mode("overwrite").parquet(path)
    return read_vectors(df.sparkSession, path, id_col, vec_col)
