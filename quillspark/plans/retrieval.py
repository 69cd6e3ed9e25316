"""Queries of vector retrieval over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import unit
from ..operators import retrieval as R


def _v(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"), "label")


def _q(v):
    """Queries: every vector whose id is divisible by 100, against all vectors."""
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("target_id"), "vector", F.col("label").alias("grp"))


def _s(v):
    return v.select(F.col("vec_id").alias("source_id"), "vector", F.col("label").alias("grp"))


def i1(spark, sf_dir):
    v = _v(spark, sf_dir)
    return R.top_k(_q(v), _s(v))


def i3(spark, sf_dir):
    v = _v(spark, sf_dir)
    return R.top_k(_q(v), _s(v), exclude="same")


def i5(spark, sf_dir):
    v = _v(spark, sf_dir)
    mean = R.centroids(v, "label", "vector")
    out = R.raw_cosine(v.join(mean, "label"), "vector", "centroid")
    return out.select("vec_id", "label", F.round("cosine", 7).alias("cosine"))


def i8(spark, sf_dir):
    v = _v(spark, sf_dir)
    t, s = _q(v).withColumnRenamed("grp", "label"), _s(v).withColumnRenamed("grp", "label")
    out = R.hit_at_k(R.top_k(_q(v), _s(v)), t, s, "label")
    return out.select("label", "n", F.round("hit_1", 9).alias("hit_1"), F.round("hit_k", 9).alias("hit_k"))


def _with_family(v, k=10):
    return R.top_k(_q(v), _s(v), k).join(v.select(F.col("vec_id").alias("source_id"), F.col("label").alias("family")), "source_id")


def i6(spark, sf_dir):
    return R.best_of_family(_with_family(_v(spark, sf_dir)), "family").select("target_id", "rank", "source_id", "score", "family")


def d34(spark, sf_dir):
    return R.crowding(_with_family(_v(spark, sf_dir), 3), "family")


def i4(spark, sf_dir):
    v = _v(spark, sf_dir)
    mean = R.centroids(v.select("label", unit(F.col("vector")).alias("vector")), "label", "vector")
    fam = R.raw_cosine(_q(v).crossJoin(mean), "vector", "centroid")  # every strategy is rated for every query
    fam = fam.select(F.col("label").alias("strategy_id"), F.col("label").alias("family"), "target_id", F.round("cosine", 7).alias("cosine"))
    return R.anchored(R.top_k(_q(v), _s(v), 8), v.select(F.col("vec_id").alias("source_id"), F.col("label").alias("struct")), fam)


def i13(spark, sf_dir):
    v = _v(spark, sf_dir)
    out = R.cache(R.top_k(_q(v), _s(v)))
    return out.select("target_id", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("source_ids"), F.round("mean", 7).alias("mean"), "least", "greatest")


def i10(spark, sf_dir):
    """A stored result with a swapped score and a lost row must be found out."""
    v = _v(spark, sf_dir)
    live = R.top_k(_q(v), _s(v))
    stored = live.where("not (target_id % 300 = 0 and rank = 3)").withColumn("score", F.when((F.col("target_id") % 200 == 0) & (F.col("rank") == 2), F.col("score") + 1).otherwise(F.col("score")))
    return R.check_hits(stored, live)


_TOP = """n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS r FROM embeddings),
sc AS (SELECT q.vec_id AS target_id, q.label AS want, s.vec_id AS source_id, s.label AS family, round_even(list_inner_product(q.e, s.e) / (q.r * s.r), 7) AS score FROM n q JOIN n s ON q.vec_id <> s.vec_id{0} WHERE q.vec_id % 100 = 0),
hit AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id) AS rank FROM sc QUALIFY rank <= {1})"""
_MEAN = "m AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]{0}) AS a FROM n, range(1, 4097) t(i) WHERE i <= len(e) GROUP BY ALL) GROUP BY label)"
QUERIES = {"i1_cosine_top_k": i1, "i3_top_k_excluding_group": i3, "i5_raw_cosine": i5, "i8_hit_at_k": i8, "i6_family_top_k": i6, "d34_crowding": d34, "i4_anchored_rerank": i4, "i13_retrieval_cache": i13, "i10_check_hits": i10}
ORACLES = {
    "i1_cosine_top_k": f"WITH {_TOP.format('', 3)} SELECT target_id, rank, source_id, score FROM hit",
    "i3_top_k_excluding_group": f"WITH {_TOP.format(' AND q.label <> s.label', 3)} SELECT target_id, rank, source_id, score FROM hit",
    "i5_raw_cosine": f"WITH {_TOP.format('', 3)}, {_MEAN.format('')} SELECT vec_id, label, round(list_inner_product(e, c) / (r * sqrt(list_inner_product(c, c))), 7) AS cosine FROM n JOIN m USING (label)",
    "i8_hit_at_k": f"WITH {_TOP.format('', 3)} SELECT want AS label, count(*) AS n, round(avg(h1), 9) AS hit_1, round(avg(hk), 9) AS hit_k FROM (SELECT target_id, want, max((family = want AND rank = 1)::INT) AS h1, max((family = want)::INT) AS hk FROM hit GROUP BY ALL) GROUP BY want",
    "i6_family_top_k": f"WITH {_TOP.format('', 10)}, f AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY target_id, family ORDER BY score DESC, source_id) = 1) SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id) AS rank, source_id, score, family FROM f QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id) <= 3",
    "d34_crowding": f"WITH {_TOP.format('', 3)} SELECT families, count(*) AS targets FROM (SELECT target_id, count(DISTINCT family) AS families FROM hit GROUP BY ALL) GROUP BY families",
    "i4_anchored_rerank": f"WITH {_TOP.format('', 8)}, {_MEAN.format(' / r')}, f AS (SELECT q.vec_id AS target_id, m.label AS strategy_id, round(list_inner_product(q.e, m.c) / (q.r * sqrt(list_inner_product(m.c, m.c))), 7) AS cosine FROM n q, m WHERE q.vec_id % 100 = 0), v AS (SELECT target_id, family, count(*) AS votes FROM hit GROUP BY ALL) SELECT f.target_id, row_number() OVER (PARTITION BY f.target_id ORDER BY v.votes DESC, cosine DESC, strategy_id) AS rank, strategy_id, v.votes, cosine FROM f JOIN v ON v.target_id = f.target_id AND v.family = f.strategy_id QUALIFY rank <= 3",
    "i13_retrieval_cache": f"WITH {_TOP.format('', 3)} SELECT target_id, string_agg(source_id::VARCHAR, ',' ORDER BY rank) AS source_ids, round(avg(score), 7) AS mean, min(score) AS least, max(score) AS greatest FROM hit GROUP BY target_id",
    "i10_check_hits": f"WITH {_TOP.format('', 3)} SELECT DISTINCT * FROM (SELECT 'missing' AS \"check\", target_id FROM hit WHERE target_id % 300 = 0 AND rank = 3 UNION ALL SELECT 'other_score', target_id FROM hit WHERE target_id % 200 = 0 AND rank = 2 UNION ALL SELECT 'not_descending', target_id FROM hit WHERE target_id % 200 = 0 AND rank = 2)",
}
