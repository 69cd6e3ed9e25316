"""Queries of statistics, integrity checks and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import integrity as M
from ..operators import outcomes as O
from ..operators import stats as S
from .evaluation import BOOT, CLUSTER_BOOTSTRAP_SQL, SEED
from .outcomes import ARMS_SQL, arms


def k8(spark, sf_dir):
    c = O.contingency(arms(spark, sf_dir), "case", "both")
    return c.select(F.col("replicate").cast("long").alias("replicate"), "only_a", "only_b", F.round(S.mcnemar_p(F.col("only_a"), F.col("only_b")), 9).alias("p"))


def k10(spark, sf_dir):
    a = arms(spark, sf_dir).where("arm = 'case'").withColumn("v", F.col("correct").cast("double"))
    out = S.cluster_bootstrap(a, "cust", "v", BOOT, SEED)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def k11(spark, sf_dir):
    out = S.spearman(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", "o_custkey", "o_orderpriority")
    return out.select("o_orderpriority", "n", F.round("rho", 9).alias("rho"))


def k13(spark, sf_dir):
    out = S.standard_error(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")
    return out.select("event_type", "n", F.round("se", 9).alias("se"))


def m1(spark, sf_dir):
    return M.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", ["doc_id", "lang", "n_chars"], {"benchmark": "v1"})


def m2(spark, sf_dir):
    d, la, o = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "orders"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return M.violations(
        wrong_length=d.where(F.length("text") != F.col("n_chars")).select("doc_id"),
        repeated_id=d.groupBy("doc_id").count().where("count > 1").select("doc_id"),
        label_without_document=la.join(d, "doc_id", "left_anti").select("doc_id"),
        order_without_lines=o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"),
        tax_out_of_range=li.where("l_tax > 0.07").select("l_orderkey"),
    ).distinct()


def m4(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return M.leaks(d, "doc_id", "text", {"source": F.col("source"), "length": F.col("n_chars").cast("string")})


def m8(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.element_at(F.array(*(F.lit(x) for x in ("add", "subtract", "multiply", "divide", "exp"))), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit("(1, 2), add(#0, 3)")).alias("p"))
    return o.select("o_orderkey", M.corrupt_operation(F.col("p")).alias("corrupted"))


def o1(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", M.cache_key(F.lit("v1"), F.col("doc_id"), F.md5(X.collapse(F.col("text")).cast("binary"))).alias("key"))
    return M.misses(d, d.where("doc_id % 3 = 0").select("key")).select("doc_id", "key")


def o2(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("m-1").alias("model"), F.col("lang").alias("language"), (F.col("doc_id") * 0).alias("temperature"))
    return M.drifted(c, "model", "language", "temperature")


_K = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)"
QUERIES = {"k8_mcnemar": k8, "k10_cluster_bootstrap": k10, "k11_spearman": k11, "k13_standard_error": k13, "m1_manifest": m1, "m2_violations": m2, "m4_leaks": m4, "m8_corrupt_operation": m8, "o1_cache_misses": o1, "o2_runtime_drift": o2}
ORACLES = {
    "k8_mcnemar": f"WITH {ARMS_SQL}, c AS (SELECT replicate, count(*) FILTER (case_ AND NOT both_) AS a, count(*) FILTER (NOT case_ AND both_) AS b FROM wide GROUP BY ALL), t AS (SELECT *, a + b AS n, unnest(range(greatest(a, b), a + b + 1)) AS i FROM c) SELECT replicate::BIGINT AS replicate, any_value(a) AS only_a, any_value(b) AS only_b, round(least(1, 2 * sum(exp({_K}))), 9) AS p FROM t GROUP BY replicate",
    "k10_cluster_bootstrap": CLUSTER_BOOTSTRAP_SQL,
    "k11_spearman": "WITH r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS x, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS y FROM orders) SELECT o_orderpriority, count(*) AS n, round(corr(x, y), 9) AS rho FROM r GROUP BY ALL",
    "k13_standard_error": "SELECT event_type, count(value) AS n, round(stddev_samp(value) / sqrt(count(value)), 9) AS se FROM events GROUP BY ALL",
    "m1_manifest": "WITH h AS (SELECT sha256(doc_id || chr(31) || lang || chr(31) || n_chars) AS h FROM documents), g AS (SELECT count(*) AS rows, " + ", ".join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::BIGINT::HUGEINT)::VARCHAR AS p{k}" for k in range(5)) + " FROM h) SELECT 'documents' AS kind, rows, sha256(concat_ws('|', 'documents', rows, p0, p1, p2, p3, p4, 'benchmark=v1')) AS digest FROM g",
    "m2_violations": """SELECT DISTINCT * FROM (SELECT 'wrong_length' AS "check", doc_id::VARCHAR AS id FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'repeated_id', doc_id::VARCHAR FROM documents GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'label_without_document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'order_without_lines', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'tax_out_of_range', l_orderkey::VARCHAR FROM lineitem WHERE l_tax > 0.07)""",
    "m4_leaks": r"""SELECT doc_id, 'source' AS "check" FROM documents WHERE contains(lower(text), lower(source)) UNION ALL SELECT doc_id, 'length' FROM documents WHERE contains(lower(text), n_chars::VARCHAR) UNION ALL SELECT doc_id, 'year' FROM documents WHERE regexp_matches(text, '\b(19|20)[0-9]{2}\b')""",
    "m8_corrupt_operation": "SELECT o_orderkey, (['subtract(1, 2), add(#0, 3)', 'add(1, 2), add(#0, 3)', 'divide(1, 2), add(#0, 3)', 'multiply(1, 2), add(#0, 3)', 'exp(1, 2), subtract(#0, 3)'])[o_orderkey % 5 + 1] AS corrupted FROM orders",
    "o1_cache_misses": r"SELECT doc_id, sha256('v1' || chr(31) || doc_id || chr(31) || md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) AS key FROM documents WHERE doc_id % 3 <> 0",
    "o2_runtime_drift": "SELECT 'language' AS setting, count(DISTINCT lang) AS \"values\" FROM documents",
}
