"""Queries of grouping, ranking, sampling, sets and ingestion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import tables as T


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df, digits=6):
    return df.select(*(F.round(F.col(c), digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _order_tables(spark, sf_dir):
    """Each order's lines as a text table: header, then a row a line number."""
    li = _t(spark, sf_dir, "lineitem")
    row = F.array(F.concat(F.lit("line "), F.col("l_linenumber")), F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_returnflag") == "N", ".").otherwise(F.col("l_returnflag")))
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda s: s["r"]).alias("rows"))
    return rows.select("l_orderkey", F.concat(F.array(F.array(F.lit("item"), F.lit("quantity"), F.lit(""))), F.col("rows")).alias("table"))


def b3(spark, sf_dir):
    return T.table_facts(_order_tables(spark, sf_dir), "table", "l_orderkey").select("l_orderkey", F.col("row_idx").cast("long").alias("row_idx"), F.col("col_idx").cast("long").alias("col_idx"), "entity", "column", "value")


def b2(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    nested = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return T.explode_questions(nested, "turns", "conv_id").select("conv_id", F.col("position").cast("long").alias("position"), "turn", "role", F.length("text").cast("long").alias("n_chars"))


def b17(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return T.keep_children(c, "turns", lambda x: (x["role"] == "user") & (x["turn"] > 1)).select("conv_id", F.size("turns").cast("long").alias("kept"))


def b4(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    name = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: F.concat_ws(" ", x["role"], x["turn"].cast("string")))
    facts = T.prefixed_facts(name("user"), F.array().cast("array<string>"), name("assistant"))
    return c.select("conv_id", F.size(facts).cast("long").alias("facts"), F.array_join(facts, "; ").alias("joined"))


def b15(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    b = F.when(F.col("o_totalprice") > 300000, "A").when(F.col("o_orderpriority").startswith("1"), "B").when(F.col("o_orderstatus") == "F", "C").otherwise("H")
    return o.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def b12(spark, sf_dir):
    return T.profile(_t(spark, sf_dir, "documents"), ["text", "lang", "n_chars"], "source")


def d1(spark, sf_dir):
    return T.most_common(_t(spark, sf_dir, "events"), "event_type", "event_id", 3)


def d17(spark, sf_dir):
    c = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("count"))
    return _round(T.cumulative_share(c, "source").select("source", "count", F.col("rank").cast("long").alias("rank"), "share"), 9)


def d18(spark, sf_dir):
    return _round(T.distribution(_t(spark, sf_dir, "documents").withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "lang"))


def d31(spark, sf_dir):
    return _round(T.entropy(_t(spark, sf_dir, "events"), "event_type", "user_id"))


def d14(spark, sf_dir):
    return _round(T.pivot_mean(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"], "l_quantity"))


def d20(spark, sf_dir):
    return T.duplicates(_t(spark, sf_dir, "documents"), TX.collapse(F.col("text")))


def d30(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc_nulls_last("value")))).where("_r <= 4").groupBy("user_id").agg(F.collect_list(F.col("value")).alias("v"))
    s = T.score_stats(F.col("v"))
    return _round(e.select("user_id", s.alias("s")).select("user_id", "s.*"))


def d29(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return _round(T.confusion(o, F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "F", "o_orderpriority"), 9)


def d36(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return _round(T.overlap(d.where("lang = 'en'").select("source"), d.where("lang = 'fr'").select("source"), "source"), 9)


def d37(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.md5(TX.collapse(F.col("text")).cast("binary")).alias("h"), (F.col("doc_id") % 2).alias("side"))
    g = d.groupBy("h").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")).where("a > 0 and b > 0")
    return g.agg(F.count("*").alias("shared"), F.sum("a").alias("rows_a"), F.sum("b").alias("rows_b"))


def d44(spark, sf_dir):
    n = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    b = F.when(F.col("n").between(1, 1), "1").when(F.col("n").between(2, 3), "2-3").otherwise("4+")
    return n.groupBy(b.alias("bucket")).agg(F.count("*").alias("orders"))


def e4(spark, sf_dir):
    d = T.first_seen(_t(spark, sf_dir, "documents"), TX.collapse(F.col("text")), "doc_id")
    return d.select("doc_id", "lang")


def e5(spark, sf_dir):
    return T.terciles(_t(spark, sf_dir, "documents"), "n_chars", "doc_id")


def f5(spark, sf_dir):
    return T.hash_sample(_t(spark, sf_dir, "documents"), "doc_id", 25, "pick").select("doc_id")


def f7(spark, sf_dir):
    return T.quota_sample(_t(spark, sf_dir, "documents"), "lang", "doc_id", {"en": 12, "fr": 14, "de": 18}, "quota").select("doc_id", "lang")


def f8(spark, sf_dir):
    return T.one_of_each_within(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", "o_orderkey", 5, "strat").select("o_orderkey", "o_orderpriority")


def f13(spark, sf_dir):
    out = T.corruption_levels(_t(spark, sf_dir, "documents"), "doc_id", [0.0, 0.1, 0.25, 0.5], "corrupt")
    return out


def f11(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"), F.avg((F.col("user_id") % 3).cast("double")).alias("coverage"), F.max(F.col("value")).alias("metric"))
    c = e.withColumn("always_base", F.col("name") == "view").withColumn("threshold", F.lit(0.1))
    return T.one_standard_error(c).select("name")


def c2(spark, sf_dir):
    d, la = _t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id", "quality")
    return T.left_with_default(d, la, "doc_id", "quality", 0).groupBy("missing").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


def c3(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    live = d.where("doc_id % 97 <> 5").withColumn("n_chars", F.when(F.col("doc_id") % 89 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return T.keyed_diff(d.where("doc_id % 101 <> 7"), live, "doc_id", ["lang", "n_chars"])


def c5(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5(TX.collapse(F.col("text")).cast("binary")).alias("h"))
    train = d.where("doc_id % 2 = 0").select("h").distinct()
    return d.where("doc_id % 2 = 1").join(train, "h", "left_semi").select("doc_id")


def b18(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "grp")
    out = T.holdout(o.where("o_orderkey % 3 = 2"), "grp", o.where("o_orderkey % 3 = 0").select("grp"), o.where("o_orderkey % 3 = 1 and o_orderstatus = 'F'").select("grp"))
    return out.select("o_orderkey", "grp")


def c10(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return T.latest([d.where("doc_id % 2 = 0").withColumn("v", F.lit("old")), d.where("doc_id % 3 = 0").withColumn("v", F.lit("new"))], "doc_id")


def c8(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("who", F.concat_ws(" ", "role", F.col("turn").cast("string")))
    return T.ranked_block(c, "conv_id", "turn", "who")


_N = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
QUERIES = {
    "b2_explode_questions": b2, "b3_table_facts": b3, "b4_prefixed_facts": b4, "b12_blank_profile": b12, "b15_buckets": b15, "b17_nested_subset": b17, "b18_holdout": b18,
    "c2_left_with_default": c2, "c3_keyed_diff": c3, "c5_semi_join": c5, "c8_ranked_block": c8, "c10_latest_wins": c10,
    "d1_most_common": d1, "d14_pivot_mean": d14, "d17_cumulative_share": d17, "d18_distribution": d18, "d20_duplicates": d20, "d29_confusion": d29, "d30_score_stats": d30, "d31_entropy": d31, "d36_split_overlap": d36, "d37_duplicate_documents": d37, "d44_range_buckets": d44,
    "e4_first_seen": e4, "e5_terciles": e5, "f5_hash_sample": f5, "f7_quota_sample": f7, "f8_stratified_sample": f8, "f11_one_standard_error": f11, "f13_corruption_levels": f13,
}
ORACLES = {
    "b2_explode_questions": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, turn, role, length(text)::BIGINT AS n_chars FROM conversations",
    "b3_table_facts": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT::VARCHAR, CASE WHEN l_returnflag = 'N' THEN '.' ELSE l_returnflag END) - 1 AS row_idx FROM lineitem)
SELECT l_orderkey, row_idx, 1::BIGINT AS col_idx, 'line ' || l_linenumber AS entity, 'quantity' AS "column", l_quantity::BIGINT::VARCHAR AS value FROM l UNION ALL SELECT l_orderkey, row_idx, 2, 'line ' || l_linenumber, 'col_2', l_returnflag FROM l WHERE l_returnflag <> 'N'""",
    "b4_prefixed_facts": "SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) AS facts, array_to_string(list(CASE role WHEN 'user' THEN 'PRE: ' ELSE 'POST: ' END || role || ' ' || turn ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, turn) FILTER (role IN ('user', 'assistant')), '; ') AS joined FROM conversations GROUP BY conv_id",
    "b12_blank_profile": "SELECT source, count(*) AS rows, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank_text, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS blank_lang, count(*) FILTER (n_chars IS NULL) AS blank_n_chars FROM documents GROUP BY source",
    "b15_buckets": "SELECT CASE WHEN o_totalprice > 300000 THEN 'A' WHEN starts_with(o_orderpriority, '1') THEN 'B' WHEN o_orderstatus = 'F' THEN 'C' ELSE 'H' END AS bucket, count(*) AS n FROM orders GROUP BY ALL",
    "b17_nested_subset": "SELECT conv_id, count(*) AS kept FROM conversations WHERE role = 'user' AND turn > 1 GROUP BY conv_id",
    "b18_holdout": "SELECT o_orderkey, o_custkey AS grp FROM orders WHERE o_orderkey % 3 = 2 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderstatus = 'F'))",
    "c2_left_with_default": "SELECT l.doc_id IS NULL AS missing, count(*) AS n, sum(coalesce(quality, 0))::BIGINT AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL",
    "c3_keyed_diff": "SELECT CASE WHEN doc_id % 101 = 7 THEN 'only_right' WHEN doc_id % 97 = 5 THEN 'only_left' ELSE 'differs' END AS \"check\", doc_id FROM documents WHERE (doc_id % 101 = 7) <> (doc_id % 97 = 5) OR (doc_id % 101 <> 7 AND doc_id % 97 <> 5 AND doc_id % 89 = 3)",
    "c5_semi_join": f"SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND {_N} IN (SELECT {_N} FROM documents WHERE doc_id % 2 = 0)",
    "c8_ranked_block": "SELECT conv_id, string_agg(role || ' ' || turn, chr(10) || chr(10) ORDER BY turn, role) AS block FROM conversations GROUP BY conv_id",
    "c10_latest_wins": "SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "d1_most_common": "SELECT event_type, count(*) AS count, min(event_id) AS first_at FROM events GROUP BY ALL ORDER BY count DESC, first_at LIMIT 3",
    "d14_pivot_mean": "SELECT l_returnflag, round(coalesce(avg(l_quantity) FILTER (l_linestatus = 'O'), 0), 6) AS o, round(coalesce(avg(l_quantity) FILTER (l_linestatus = 'F'), 0), 6) AS f FROM lineitem GROUP BY ALL",
    "d17_cumulative_share": "WITH c AS (SELECT source, count(*) AS count FROM documents GROUP BY source) SELECT source, count, row_number() OVER w AS rank, round(sum(count) OVER w / sum(count) OVER (), 9) AS share FROM c WINDOW w AS (ORDER BY count DESC, source COLLATE C)",
    "d18_distribution": "SELECT lang, count(n_chars) AS n, min(n_chars)::DOUBLE AS least, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, max(n_chars)::DOUBLE AS greatest FROM documents GROUP BY lang",
    "d20_duplicates": f"SELECT sum(c)::BIGINT AS rows, count(*) AS keys, sum(c - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS c FROM documents GROUP BY {_N})",
    "d29_confusion": "SELECT o_orderpriority, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM (SELECT o_orderpriority, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT *, o_totalprice > 200000 AS p, o_orderstatus = 'F' AS a FROM orders) GROUP BY ALL)",
    "d30_score_stats": "WITH f AS (SELECT user_id, list_concat(list_sort(list(value), 'DESC'), [0.0, 0.0, 0.0, 0.0]::DOUBLE[])[1:4] AS v FROM events GROUP BY user_id), m AS (SELECT *, (v[1] + v[2] + v[3] + v[4]) / 4 AS a FROM f) SELECT user_id, round(v[1], 6) AS top, round(v[2], 6) AS second, round(a, 6) AS mean, round(sqrt((pow(v[1] - a, 2) + pow(v[2] - a, 2) + pow(v[3] - a, 2) + pow(v[4] - a, 2)) / 4), 6) AS deviation, round(v[1] - v[2], 6) AS margin FROM m",
    "d31_entropy": "WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n FROM c) SELECT user_id, any_value(n)::BIGINT AS n, round(-sum(c / n * ln(c / n + 1e-12)), 6) AS entropy, round(max(c) / any_value(n), 6) AS mode_share FROM t GROUP BY user_id",
    "d36_split_overlap": "WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'fr') SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys, count(*) AS shared, round(count(*) / (SELECT count(*) FROM a), 9) AS share FROM a JOIN b USING (source)",
    "d37_duplicate_documents": f"SELECT count(*) AS shared, sum(a)::BIGINT AS rows_a, sum(b)::BIGINT AS rows_b FROM (SELECT count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY {_N}) WHERE a > 0 AND b > 0",
    "d44_range_buckets": "SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' ELSE '4+' END AS bucket, count(*) AS orders FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY ALL",
    "e4_first_seen": f"SELECT min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY {_N}",
    "e5_terciles": "WITH v AS (SELECT list_sort(list(n_chars)) AS v FROM documents) SELECT doc_id, n_chars, CASE WHEN n_chars <= v[len(v) // 3 + 1] THEN 'low' WHEN n_chars <= v[2 * len(v) // 3 + 1] THEN 'mid' ELSE 'high' END AS bin FROM documents, v",
    "f5_hash_sample": "SELECT doc_id FROM documents ORDER BY sha256('pick|' || doc_id) LIMIT 25",
    "f7_quota_sample": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('quota|' || doc_id)) <= CASE lang WHEN 'en' THEN 12 WHEN 'fr' THEN 14 WHEN 'de' THEN 18 ELSE 0 END",
    "f8_stratified_sample": "WITH a AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY sha256('strat|' || o_orderkey)) = 1) SELECT o_orderkey, o_orderpriority FROM a QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('strat|' || o_orderkey)) <= 5",
    "f11_one_standard_error": "WITH e AS (SELECT event_type AS name, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se, avg(user_id % 3) AS coverage, max(value) AS metric FROM events GROUP BY ALL) SELECT name FROM e WHERE m >= (SELECT m - se FROM e ORDER BY m DESC, name LIMIT 1) - 1e-12 ORDER BY coverage, (name = 'view') DESC, metric DESC, name LIMIT 1",
    "f13_corruption_levels": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('corrupt|' || doc_id)) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, level::DOUBLE AS level, i < floor(n * level::DOUBLE + 1e-9) AS corrupted FROM r, (VALUES (0.0), (0.1), (0.25), (0.5)) l(level)",
}
