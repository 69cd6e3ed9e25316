"""Queries of sources and sinks (written and read back) and of the functions that SQL sees by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.register import register
from ..sources import files as S
from ..streaming import logs
from .evaluation import _ORDERS, _orders


def _small(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", "t", F.concat(F.lit("k,"), F.col("k").cast("string")).alias("name"))


def a1(spark, sf_dir):
    """A result written as one JSON document and read whole."""
    path = S.scratch(spark)
    S.write_json_document(_small(spark, sf_dir).where("o_orderkey < 5000"), path)
    return S.read_json(spark, path, "name string, o_orderkey long, t long", lines=False)


def a2(spark, sf_dir):
    """JSON lines written, overwritten and read; blank lines count as nothing."""
    path = S.scratch(spark)
    S.write_json_lines(_small(spark, sf_dir).limit(3), path)
    S.write_json_lines(_small(spark, sf_dir), path)
    return S.read_json(spark, path, "name string, o_orderkey long, t long")


def a3(spark, sf_dir):
    return S.read_parquet(spark, f"{sf_dir}/nation.parquet", ["n_nationkey", "n_name"])


def a4(spark, sf_dir):
    """Vectors written and read back by id before anything is searched."""
    v = S.write_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), S.scratch(spark), "vec_id", "embedding")
    return v.select(F.col("id").alias("vec_id"), F.size("vector").cast("long").alias("dims"), F.round(F.get("vector", F.lit(0)), 5).alias("first"))


def a7(spark, sf_dir):
    """An append-only log of two batches, the second one a replay of part of the first: each key once, as first written."""
    path = S.scratch(spark)
    s = _small(spark, sf_dir)
    S.append_log(s.withColumn("at", F.lit(1)), path)
    S.append_log(s.where("o_orderkey % 3 = 0").withColumn("at", F.lit(2)), path)
    back = S.read_json(spark, path, "o_orderkey long, t long, name string, at int")
    return back.groupBy("o_orderkey").agg(F.count("*").alias("written"), F.min_by("t", "at").alias("t"))


def a9(spark, sf_dir):
    path = S.scratch(spark)
    S.write_csv(_small(spark, sf_dir), path, ["name", "o_orderkey"])
    return spark.read.option("header", True).schema("name string, o_orderkey long").csv(path)


def a10(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(i, line) for i, line in enumerate(S.markdown(r).split("\n"))], "i long, line string")


def a11(spark, sf_dir):
    """Malformed lines split off and kept as dead letters with the stage that refused them."""
    path, dead = S.scratch(spark), S.scratch(spark)
    line = F.when(F.col("k") == 3, F.concat(F.lit("{broken "), F.col("o_orderkey").cast("string"))).when(F.col("k") == 4, "").otherwise(F.to_json(F.struct("o_orderkey", "t")))
    _orders(spark, sf_dir).select(line.alias("value")).write.text(path)
    from pyspark.sql import types as T

    good, bad = S.read_json_split(spark, path, T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("t", T.LongType())]))
    S.write_dead_letters(bad, dead, "read")
    d = spark.read.schema("stage string, record string").json(dead)
    return good.agg(F.count("*").alias("good"), F.sum("t").alias("t")).crossJoin(d.groupBy("stage").agg(F.count("*").alias("bad"), F.min(F.length("record")).alias("shortest")))  # one row each


def a13(spark, sf_dir):
    """A locked file is read only if digest and rows are those of its lock; what is published replaces the old table whole."""
    path, table = S.scratch(spark), S.scratch(spark)
    s = _small(spark, sf_dir)
    S.canonical_json(s).coalesce(1).write.text(path)
    d = S.digests(spark, f"{path}/part-*.txt").first()
    S.check_lock(spark, f"{path}/part-*.txt", d["sha256"], s.count())
    S.publish(spark, s.limit(1), table)
    S.publish(spark, s, table, check=lambda t: t.where("o_orderkey is null"))
    return spark.read.parquet(table).agg(F.count("*").alias("rows"), F.sum("t").alias("t"))


def q_functions(spark, sf_dir):
    """Functions and table functions by name."""
    register(spark)
    _orders(spark, sf_dir).createOrReplaceTempView("quill_orders")
    return spark.sql("""
        SELECT o_orderkey, s.step, s.op, s.a, program_canonical(program_parse(p).steps) AS canonical, (SELECT count(*) FROM derivation_tokens('(1 + 2) / x') t) AS tokens
        FROM (SELECT o_orderkey, concat('add(multiply(2, ', t, '), ', c, ')') AS p FROM quill_orders) o, LATERAL program_steps(o.p) s""")


def p_stream(spark, sf_dir):
    """The append-only log as a stream: each key once, whatever is written again."""
    path = S.scratch(spark)
    s = _small(spark, sf_dir)
    for part in (s.where("o_orderkey % 2 = 0"), s.where("o_orderkey % 3 = 0"), s.where("o_orderkey % 2 = 1")):
        S.append_log(part.withColumn("at", F.timestamp_seconds(F.col("o_orderkey") + 1_000_000)), path)
    out = S.scratch(spark)
    q = logs.once_each(spark.readStream.schema("o_orderkey long, t long, name string, at timestamp").json(path), "o_orderkey", "at", "3000 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", S.scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("o_orderkey long, t long, name string, at timestamp").parquet(out).select("o_orderkey", "t", "name")


QUERIES = {"a1_json_document": a1, "a2_json_lines": a2, "a3_parquet": a3, "a4_vectors": a4, "a7_append_log": a7, "a9_csv": a9, "a10_markdown": a10, "a11_dead_letters": a11, "a13_locked_and_published": a13, "q_sql_functions": q_functions, "p_log_stream": p_stream}
_S = f"WITH {_ORDERS}, s AS (SELECT o_orderkey, t, 'k,' || k AS name FROM o)"
ORACLES = {
    "a1_json_document": f"{_S} SELECT name, o_orderkey, t FROM s WHERE o_orderkey < 5000",
    "a2_json_lines": f"{_S} SELECT name, o_orderkey, t FROM s",
    "a3_parquet": "SELECT n_nationkey, n_name FROM nation",
    "a4_vectors": "SELECT vec_id, len(embedding) AS dims, round(embedding[1]::FLOAT::DOUBLE, 5) AS first FROM embeddings",
    "a7_append_log": f"{_S} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS written, t FROM s",
    "a9_csv": f"{_S} SELECT name, o_orderkey FROM s",
    "a10_markdown": "SELECT 0::BIGINT AS i, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey) + 1, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
    "a11_dead_letters": f"WITH {_ORDERS} SELECT count(*) FILTER (k NOT IN (3, 4)) AS good, sum(t) FILTER (k NOT IN (3, 4))::BIGINT AS t, 'read' AS stage, count(*) FILTER (k = 3) AS bad, min(length('{{\"line\":\"{{broken ' || o_orderkey || '\"}}')) FILTER (k = 3) AS shortest FROM o",
    "a13_locked_and_published": f"{_S} SELECT count(*) AS rows, sum(t)::BIGINT AS t FROM s",
    "q_sql_functions": f"WITH {_ORDERS}, m AS (SELECT o_orderkey, c::VARCHAR AS c, 'multiply(' || least('2', t::VARCHAR) || ', ' || greatest('2', t::VARCHAR) || ')' AS m FROM o), s AS (SELECT o_orderkey, 'add(' || least(c, m) || ', ' || greatest(c, m) || ')' AS canonical FROM m) SELECT o_orderkey, 0 AS step, 'multiply' AS op, '2' AS a, canonical, 7::BIGINT AS tokens FROM s UNION ALL SELECT o_orderkey, 1, 'add', '#0', canonical, 7 FROM s",
    "p_log_stream": f"{_S} SELECT o_orderkey, t, name FROM s",
}
