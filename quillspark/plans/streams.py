"""Queries of the drift guard and of upserts over a log that comes in several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from ..streaming import guard as G
from ..streaming.logs import read_log


def _log(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Events as a log of three files, in the order of their time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("u"), "user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("runtime"))
    day = F.dayofmonth("ts")
    folder = scratch(spark)
    for part in (day < 10, (day >= 10) & (day < 20), day >= 20):
        e.where(part).coalesce(1).write.mode("append").parquet(folder)
    return folder, e


def p_guard(spark, sf_dir):
    folder, e = _log(spark, sf_dir)
    out, state = scratch(spark), scratch(spark)
    log = read_log(spark, folder, e.schema, files_at_once=1)
    G.run_guarded(G.guarded(log, "key", "event_id", "runtime", "ts"), out, state)
    got = spark.read.parquet(out)
    return got.groupBy("key").agg(F.max("pinned").alias("pinned"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("turned_away"))


def p_upsert(spark, sf_dir):
    folder, e = _log(spark, sf_dir)
    out = scratch(spark)
    G.upsert(read_log(spark, folder, e.schema, files_at_once=1), "key", "ts", out, scratch(spark))
    return G.current(spark, out).select("key", "event_id")


QUERIES = {"p_drift_guard": p_guard, "p_upsert": p_upsert}
ORACLES = {
    "p_drift_guard": "WITH e AS (SELECT 'u' || user_id AS key, ts, CASE WHEN event_type <> 'view' THEN event_type END AS f FROM events), p AS (SELECT key, f AS pinned FROM e WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, f) = 1) SELECT e.key, pinned, count(*) FILTER (coalesce(f = pinned, false)) AS accepted, count(*) FILTER (NOT coalesce(f = pinned, false)) AS turned_away FROM e LEFT JOIN p USING (key) GROUP BY key, pinned",
    "p_upsert": "SELECT 'u' || user_id AS key, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
