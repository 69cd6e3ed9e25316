"""Files as digests of fixed blocks, hash trees over them, and chains of manifests that name what changed first.

A file is read in byte ranges, each by one task and a block at a time, so its size is no limit. Spark
lists the files (any store that it reads); the ranges are opened by executors, so other stores than local
and shared folders need a file system that pyarrow knows. Digests of ``FAN`` neighbours make a node of
the next level until one is left, the file's root. Two trees are compared from the roots downwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .files import _open, scratch

#: Bytes of a block, blocks that a task reads in turn, and children of a node.
BLOCK, RANGE, FAN = 1 << 20, 64, 256


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that nothing below it is computed again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(spark: SparkSession, path: str, size: int = BLOCK, content: bool = False) -> DataFrame:
    """(path, block, start, bytes, sha256) of every block of the files below ``path``, with its ``content`` if asked for.

    Empty files have no blocks (Spark does not list them). Ranges of ``RANGE`` blocks are dealt to tasks by path and place, so
    one large file is read by many.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")  # contents are not read
    count = F.ceil(F.col("length") / size).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), count - 1, F.lit(RANGE).cast("long"))).alias("first"), count.alias("n"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranges = ranges.select("path", "length", "first", F.least(F.col("first") + RANGE, F.col("n")).alias("end")).repartition(tasks, "path", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length, first, end in zip(*(b.column(c).to_pylist() for c in ("path", "length", "first", "end")), strict=True):
                with _open(name) as f:
                    f.seek(first * size)
                    for k in range(first, end):
                        want = min(size, length - k * size)
                        data = f.read(want)
                        if len(data) != want:
                            raise OSError(f"{name} is shorter than it was when it was listed")
                        row = [[name], [k], [k * size], [want], [hashlib.sha256(data).hexdigest()], *([[data]] if content else [])]
                        yield pa.RecordBatch.from_pylist([dict(zip(names, (x[0] for x in row), strict=True))], schema=arrow)

    names = ["path", "block", "start", "bytes", "sha256", *(["content"] if content else [])]
    arrow = pa.schema(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if content else [])], strict=True))
    return ranges.mapInArrow(read, "path string, block long, start long, bytes long, sha256 string" + (", content binary" if content else ""))


def tree(leaves: DataFrame, fan: int = FAN, name: str = "path", at: str = "block", digest: str = "sha256") -> DataFrame:
    """(path, level, at, digest): the blocks as level 0, then one node for each ``fan`` nodes below until a file has one.

    A file's blocks are numbered without gaps; its nodes depend on them alone. A node is the SHA-256 of its children's digests in
    order. A group holds ``fan`` rows at most, whatever the file.
    """
    level = leaves.select(F.col(name).alias("path"), F.lit(0).alias("level"), F.col(at).cast("long").alias("at"), F.col(digest).alias("digest"))
    out = level = _kept(level)
    heads = level.groupBy("path").agg(F.count("*").alias("n"))
    most, k, below = heads.agg(F.max("n")).first()[0] or 0, 0, 1
    while below < most:
        k += 1
        # files that have one node already go no further
        up = level.join(heads.where(F.col("n") > below).select("path"), "path", "left_semi")
        up = up.groupBy("path", F.floor(F.col("at") / fan).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("c"))  # fan rows
        level = _kept(up.select("path", F.lit(k).alias("level"), "at", F.sha2(F.array_join("c.digest", ""), 256).alias("digest")))
        out, below = out.unionByName(level), below * fan
    return out


def roots(nodes: DataFrame) -> DataFrame:
    """(path, digest, blocks) of each file of a tree."""
    return nodes.groupBy("path").agg(F.max_by("digest", "level").alias("digest"), F.count_if(F.col("level") == 0).alias("blocks"))


def changed_blocks(old: DataFrame, new: DataFrame, fan: int = FAN) -> DataFrame:
    """(path, block, change) of blocks that two trees do not share: ``changed``, ``added`` or ``removed``.

    From the roots down only children of nodes that differ are compared; trees of unequal height meet at
    the height of the lower one.
    """
    height = lambda t: t.groupBy("path").agg(F.max("level").alias("h"))
    both = height(old).join(height(new).withColumnRenamed("h", "h2"), "path", "full_outer").select("path", F.coalesce(F.least("h", "h2"), F.lit(0)).alias("start"))
    both = _kept(both)
    top = both.agg(F.max("start")).first()[0]
    differ = None
    for k in range(top if top is not None else 0, -1, -1):
        side = lambda t, d: t.where(F.col("level") == k).select("path", "at", F.col("digest").alias(d))  # noqa: B023, E731
        nodes = side(old, "a").join(side(new, "b"), ["path", "at"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        asked = both.where(F.col("start") == k).select("path")
        first = nodes.join(asked, "path", "left_semi")
        if differ is not None:
            under = nodes.withColumn("up", F.floor(F.col("at") / fan)).join(differ.select("path", F.col("at").alias("up")), ["path", "up"], "left_semi").drop("up")
            first = first.unionByName(under)
        differ = _kept(first.select("path", "at", "a", "b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return differ.select("path", F.col("at").alias("block"), change.alias("change"))


def chain(artifacts: DataFrame) -> DataFrame:
    """(stage, name, root, digest) of artifacts (stage, name, root), each bound to all before it.

    The digest of a stage is the SHA-256 of its name, its root and the digest of the stage before. One
    row a stage: a build has a few dozen.
    """
    steps = artifacts.agg(F.sort_array(F.collect_list(F.struct(F.col("stage").cast("long").alias("stage"), "name", "root"))).alias("s"))

    def link(acc, s):
        own = F.sha2(F.concat_ws("|", s["name"], s["root"], acc["digest"]), 256)
        return F.struct(own.alias("digest"), F.concat(acc["out"], F.array(F.struct(s["stage"].alias("stage"), s["name"].alias("name"), s["root"].alias("root"), own.alias("digest")))).alias("out"))

    start = F.struct(F.lit("").alias("digest"), F.array().cast("array<struct<stage:bigint,name:string,root:string,digest:string>>").alias("out"))
    return steps.select(F.inline(F.aggregate("s", start, link, lambda acc: acc["out"])))


def broken(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(stage, name, fault): ``changed`` where an artifact's own root differs from its stored manifest, ``stale`` where only something before it does, ``missing`` or ``new``."""
    a, b = (t.select("stage", "name", F.col("root").alias(r), F.col("digest").alias(d)) for t, r, d in ((stored, "r1", "d1"), (now, "r2", "d2")))
    x = a.join(b, ["stage", "name"], "full_outer")
    fault = F.when(F.col("d2").isNull(), "missing").when(F.col("d1").isNull(), "new").when(F.col("r1") != F.col("r2"), "changed").when(F.col("d1") != F.col("d2"), "stale")
    return x.select("stage", "name", fault.alias("fault")).where("fault is not null")
