"""Queries of block digests, hash trees and chains of manifests over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import blocks as B
from ..sources import builds as S
from ..sources.files import scratch

#: Bytes of a block and children of a node in these queries: small, so that small tables have several levels.
SIZE, FAN, KEYS, STAGES = 4_096, 4, 2_000, 5


def _line(price):
    return F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.floor(price * 100).cast("long").cast("string"))


def _written(spark: SparkSession, sf_dir: str, price) -> str:
    """Orders as text files, one for each ``KEYS`` keys, lines in the order of their key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor(F.col("o_orderkey") / KEYS).alias("part"), _line(price).alias("value"))
    path = scratch(spark)
    o.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    return path


def _named(df: DataFrame) -> DataFrame:
    """df by the number of the file, not by its path."""
    return df.withColumn("part", F.regexp_extract("path", r"part=(\d+)", 1).cast("long")).drop("path")


def _tree(spark: SparkSession, path: str) -> DataFrame:
    leaves = B.blocks(spark, f"{path}/*/*.txt", SIZE)
    return B.tree(leaves.select(F.regexp_extract("path", r"part=\d+", 0).alias("path"), "block", "sha256"), FAN)


def _price():
    return F.col("o_totalprice")


def _edited():
    """One price in about 3,000 is another: an edit that some files and blocks do not see."""
    return F.when(F.col("o_orderkey") % 3001 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))


def a13_blocks(spark, sf_dir):
    return _named(B.blocks(spark, f"{_written(spark, sf_dir, _price())}/*/*.txt", SIZE)).select("part", "block", "start", "bytes", "sha256")


def a13_tree(spark, sf_dir):
    return _named(_tree(spark, _written(spark, sf_dir, _price()))).select("part", "level", "at", "digest")


def a13_changed(spark, sf_dir):
    """The blocks of an edited copy that differ, found from the roots of both trees."""
    old, new = (_tree(spark, _written(spark, sf_dir, p)) for p in (_price(), _edited()))
    return _named(B.changed_blocks(old, new, FAN)).select("part", "block", "change")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """The chain of ``STAGES`` artifacts; an artifact is every so manyth file, its root that of a tree over its files' roots."""
    files = _named(B.roots(_tree(spark, path)))
    name = F.concat(F.lit("stage="), (F.col("part") % STAGES).cast("string"))
    own = B.tree(files.select(name.alias("path"), F.floor(F.col("part") / STAGES).alias("block"), F.col("digest").alias("sha256")), FAN)
    return B.chain(B.roots(own).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("stage"), F.col("path").alias("name"), F.col("digest").alias("root")))


def m1_chain(spark, sf_dir):
    """Manifests of a build, kept and made anew over the edited copy: which artifact changed, and which only follow from it."""
    stored, now = (_manifests(spark, _written(spark, sf_dir, p)) for p in (_price(), _edited()))
    return stored.join(B.broken(stored, now), ["stage", "name"], "left").select("stage", "name", "digest", "fault")


def a14_build(spark, sf_dir):
    """A build of three stages run four times: at first, again, with a new version of the second stage, and after the last stage's bytes were touched."""
    folder, target, source = scratch(spark), scratch(spark), _written(spark, sf_dir, _price())
    lines = F.split("value", r"\|")
    pool = lambda: spark.read.text(f"{source}/*/*.txt").select(lines[0].cast("long").alias("id"), lines[1].alias("status"), lines[2].cast("long").alias("cents"))
    stages = lambda v: [
        S.Stage("pool", pool, check=lambda t: t.where("id is null or cents is null")),
        S.Stage("open", lambda pool: pool.where(F.col("status") == "O"), ["pool"], v),
        S.Stage("sums", lambda pool, open: pool.groupBy("status").agg(F.sum("cents").alias("cents")).join(open.groupBy("status").agg(F.count("*").alias("n")), "status", "left"), ["pool", "open"]),
    ]
    build = S.Build(spark, folder, target, {"orders": (source, None)})
    runs = [build.run(stages("1")), build.run(stages("1")), build.run(stages("2"))]
    spark.range(1).select(F.lit("X").alias("status"), F.lit(1).cast("long").alias("cents"), F.lit(1).cast("long").alias("n")).write.mode("append").parquet(f"{folder}/sums")
    runs.append(build.run(stages("2")))
    rows = [(i, m["name"], m["action"], m["rows"]) for i, r in enumerate(runs) for m in r]
    done = spark.createDataFrame(rows, "run int, stage string, action string, rows long")
    cents = spark.read.parquet(f"{target}/sums").agg(F.sum("cents").alias("cents"))
    return done.crossJoin(cents)  # twelve rows and one


QUERIES = {"a13_blocks": a13_blocks, "a13_tree": a13_tree, "a13_changed": a13_changed, "m1_chain": m1_chain, "a14_canonical_build": a14_build}


def _blocks_sql(t: str, price: str) -> str:
    return f"""{t} AS (SELECT o_orderkey // {KEYS} AS part, string_agg(o_orderkey || '|' || o_orderstatus || '|' || floor({price} * 100)::BIGINT || chr(10), '' ORDER BY o_orderkey) AS x FROM orders GROUP BY 1),
{t}_b AS (SELECT part, k AS block, k * {SIZE} AS start, substr(x, k * {SIZE} + 1, {SIZE}) AS c FROM (SELECT part, x, unnest(range(0, (len(x) + {SIZE - 1}) // {SIZE})) AS k FROM {t}))"""


def _tree_sql(to: str, leaves: str) -> str:
    """A tree over (part, at, digest)."""
    return f"""{to} AS (SELECT part, 0 AS level, "at", digest, count(*) OVER (PARTITION BY part) AS n FROM ({leaves})
UNION ALL SELECT part, level + 1, "at" // {FAN}, sha256(string_agg(digest, '' ORDER BY "at")), count(*) OVER (PARTITION BY part) FROM {to} WHERE n > 1 GROUP BY part, level, "at" // {FAN})"""


def _chain_sql(t: str) -> str:
    tops = f"SELECT part % {STAGES} AS part, part // {STAGES} AS \"at\", arg_max(digest, level) AS digest FROM {t}_t GROUP BY {t}_t.part"
    return f"""{_tree_sql(t + "_s", tops)}, {t}_r AS (SELECT part AS stage, 'stage=' || part AS name, arg_max(digest, level) AS root FROM {t}_s GROUP BY part),
{t}_c AS (SELECT stage, name, root, sha256(name || '|' || root || '|') AS digest FROM {t}_r WHERE stage = 0 UNION ALL SELECT r.stage, r.name, r.root, sha256(r.name || '|' || r.root || '|' || c.digest) FROM {t}_c c JOIN {t}_r r ON r.stage = c.stage + 1)"""


_OWN, _NEW = _blocks_sql("f", "o_totalprice"), _blocks_sql("e", "(CASE WHEN o_orderkey % 3001 = 5 THEN o_totalprice + 1 ELSE o_totalprice END)")
_TREES = ", ".join(_tree_sql(f"{t}_t", f"SELECT part, block AS \"at\", sha256(c) AS digest FROM {t}_b") for t in "fe")
ORACLES = {
    "a13_blocks": f"WITH {_OWN} SELECT part, block, start, len(c)::BIGINT AS bytes, sha256(c) AS sha256 FROM f_b",
    "a13_tree": f"WITH RECURSIVE {_OWN}, {_NEW}, {_TREES} SELECT part, level, \"at\", digest FROM f_t",
    "a13_changed": f"WITH {_OWN}, {_NEW} SELECT part, block, CASE WHEN f_b.c IS NULL THEN 'added' WHEN e_b.c IS NULL THEN 'removed' ELSE 'changed' END AS change FROM f_b FULL JOIN e_b USING (part, block) WHERE f_b.c IS DISTINCT FROM e_b.c",
    "m1_chain": f"WITH RECURSIVE {_OWN}, {_NEW}, {_TREES}, {_chain_sql('f')}, {_chain_sql('e')} SELECT a.stage, a.name, a.digest, CASE WHEN a.root <> b.root THEN 'changed' WHEN a.digest <> b.digest THEN 'stale' END AS fault FROM f_c a JOIN e_c b USING (stage)",
    "a14_canonical_build": """WITH o AS (SELECT o_orderstatus AS s, floor(o_totalprice * 100)::BIGINT AS c FROM orders), r(run, stage, action) AS (VALUES (0, 'pool', 'made'), (0, 'open', 'made'), (0, 'sums', 'made'), (1, 'pool', 'kept'), (1, 'open', 'kept'), (1, 'sums', 'kept'),
(2, 'pool', 'kept'), (2, 'open', 'made'), (2, 'sums', 'made'), (3, 'pool', 'kept'), (3, 'open', 'kept'), (3, 'sums', 'made'))
SELECT run, stage, action, CASE stage WHEN 'pool' THEN (SELECT count(*) FROM o) WHEN 'open' THEN (SELECT count(*) FROM o WHERE s = 'O') ELSE (SELECT count(DISTINCT s) FROM o) END AS rows, (SELECT sum(c)::BIGINT FROM o) AS cents FROM r""",
}
