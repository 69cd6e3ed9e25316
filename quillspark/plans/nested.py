"""Queries of open feature maps, alignment features and nested policies, over orders, their lines and arms derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import nested as N
from .outcomes import ARMS_SQL, arms
from .rules import _Q, _ROLE, _SECOND, _questions

_ARMS, _BASE, _PRIOR = ["none", "case", "strategy"], "both", ["strategy", "none", "case"]


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cust, meta, extra): open maps of what orders and their lines hold; names differ from row to row."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    li = li.agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("r"))
    x = o.join(li, "o_orderkey", "left")
    entry = lambda n, v: F.struct(n.alias("name") if not isinstance(n, str) else F.lit(n).alias("name"), v.cast("double").alias("value"))
    one = F.lit(1.0)
    meta = F.array(entry("q_price", F.col("o_totalprice") / 1e5), entry("q_month", F.month("o_orderdate")), entry("q_lines", F.coalesce("n", F.lit(0.0))), entry(F.concat(F.lit("status_"), "o_orderstatus"), one), entry(F.concat(F.lit("priority_"), "o_orderpriority"), one), entry(F.concat(F.lit("day_"), F.dayofmonth("o_orderdate").cast("string")), one))
    extra = F.array(entry("ratio_likelihood", F.col("o_orderkey") % 7 / 7), entry("table_heavy_reasoning", F.coalesce(F.col("q"), F.lit(0.0)) / 50), entry("case_applicability", F.col("o_orderkey") % 11 / 11), entry("strategy_applicability", F.col("d")), entry("ambiguity_risk", F.col("o_orderkey") % 13 / 13), entry("case_copy_risk", F.col("r")))
    held = F.filter(extra, lambda e: e["value"] != 0)
    return x.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.map_from_entries(meta).alias("meta"), F.map_from_entries(held).alias("extra"))


def l1(spark, sf_dir):
    """Maps as sparse vectors over their numbered names."""
    m = _maps(spark, sf_dir).select("id", F.map_concat("meta", "extra").alias("m"))
    known = N._kept(N.dictionary(N.entries(m, "id", "m")))
    v = N.sparse(m, "id", "m", known)
    return v.select("id", F.array_join("indices", ",").alias("indices"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def l1_dictionary(spark, sf_dir):
    m = _maps(spark, sf_dir).select("id", F.map_concat("meta", "extra").alias("m"))
    return N.dictionary(N.entries(m, "id", "m"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arms(spark, sf_dir)
    both = F.max(F.when(F.col("arm") == _BASE, F.col("correct")))
    wide = a.groupBy("sample_id", "replicate").agg(*(F.max(F.when(F.col("arm") == n, F.col("correct"))).alias(n) for n in _ARMS), both.alias(_BASE))
    mean = lambda c: F.avg(c.cast("double"))
    p = wide.groupBy(F.col("sample_id").alias("id")).agg(*(mean(F.col(n)).alias(f"p_{n}") for n in [*_ARMS, _BASE]), *(mean(F.col(n) & ~F.col(_BASE)).alias(f"gain_{n}") for n in _ARMS), *(mean(~F.col(n) & F.col(_BASE)).alias(f"harm_{n}") for n in _ARMS))
    m = _maps(spark, sf_dir)
    part = lambda *names: F.map_filter("extra", lambda k, v: k.isin(*names))
    compatible, interaction = part("ratio_likelihood", "table_heavy_reasoning", "case_applicability", "strategy_applicability"), part("ambiguity_risk", "case_copy_risk")
    return m.join(p.hint("merge"), "id").select(*p.columns, "cust", "meta", F.map_concat("meta", compatible).alias("meta_compatible"), interaction.alias("interaction"), F.map_concat("meta", interaction).alias("meta_interaction"))


_SETS = {"existing_meta": "meta", "existing_meta_plus_compatibility": "meta_compatible", "synthetic_interaction": "interaction", "existing_meta_plus_interaction": "meta_interaction"}


def _run(spark: SparkSession, sf_dir: str) -> N.NestedRun:
    return N.nested_policy(_records(spark, sf_dir), "id", "cust", _ARMS, _BASE, _SETS, prior=_PRIOR)


def l8_table(spark, sf_dir):
    """Every candidate of every outer fold with its inner ratings."""
    t = _run(spark, sf_dir).table
    return t.select("f", "number", "architecture", "set", "threshold", "lam", *(F.round(c, 9).alias(c) for c in ("mean_utility", "se_utility", "mean_gain", "se_gain", "coverage")))


def l8_policy(spark, sf_dir):
    """What the picked candidates gain on folds that they never saw."""
    c = _run(spark, sf_dir).choices
    return c.groupBy("outer", "chosen").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("value"), F.round(F.avg("base_value"), 9).alias("base_value"))


def l8_choice(spark, sf_dir):
    """The conservative choice among plain rules: leave the base for an arm on the samples below a threshold, rated on three folds of customers."""
    r = _records(spark, sf_dir).select("id", "cust", *(f"p_{a}" for a in [*_ARMS, _BASE]))
    rules = F.explode(F.array(*(F.struct(F.lit(3 * i + j).alias("number"), F.lit(a).alias("arm"), F.lit(t).alias("threshold")) for i, a in enumerate(_ARMS) for j, t in enumerate((0.0, 0.3, 0.7)))))
    x = r.withColumn("c", rules).withColumn("left", F.col("id") % 10 < F.col("c.threshold") * 10)
    value = F.when(F.col("left"), F.coalesce(*(F.when(F.col("c.arm") == a, F.col(f"p_{a}")) for a in _ARMS))).otherwise(F.col(f"p_{_BASE}"))
    x = x.select((F.col("id") % 4).alias("f"), (F.col("cust") % 3).alias("g"), F.col("c.number").alias("number"), F.col("c.threshold").alias("threshold"), value.alias("value"), F.col(f"p_{_BASE}").alias("base_value"), "left")
    t = N.rated(x, "f", "number", "threshold")
    t = t.withColumn("architecture", F.when(F.col("threshold") == 0, "always_base").otherwise("rule")).withColumn("lam", F.lit(None).cast("double"))
    return N.conservative(t.withColumn("mean_gain", F.round("mean_gain", 12)).withColumn("se_gain", F.round("se_gain", 12)), "f").select("f", "number", F.round("mean_gain", 9).alias("mean_gain"), F.round("coverage", 9).alias("coverage"))


_OPS = [["subtract", "divide"], ["divide"], ["table_average"], ["add"], ["greater"], ["multiply"], []]
_TEXTS = ["percentage change in the revenue over the prior period", "average of the total cost", "share of the whole in percent", "sum of units", "compare the price of 2018 to 2019 in million", "a fraction of the current income", "plain note"]


def l10(spark, sf_dir):
    """Alignment features of questions put together from orders: the cases are the orders after each, strategies a few texts that every question meets two of."""
    q = _questions(spark, sf_dir)
    ops = F.element_at(F.array(*(F.array(*map(F.lit, o)).cast("array<string>") for o in _OPS)), (F.col("o_orderkey") % len(_OPS) + 1).cast("int"))
    cases = A.read_cases(q.select("o_orderkey", "q", "a", ops.alias("ops"), F.size(ops).alias("steps")), "o_orderkey", "q", "a", "ops", "steps")
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("n_nationkey") % len(_TEXTS) + 1).cast("int"))
    programs = F.element_at(F.array(*(F.array(F.array(*map(F.lit, o)).cast("array<string>")) for o in _OPS)), ((F.col("n_nationkey") * 3) % len(_OPS) + 1).cast("int"))
    s = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), text.alias("t"), programs.alias("p"), F.when(F.col("n_nationkey") % 2 == 0, "percent").otherwise("").alias("scale"))
    strategies = A.read_strategies(s, "k", "t", "p", "scale")
    near = lambda kind, source, rank: F.struct(F.lit(kind).alias("kind"), source.cast("long").alias("source"), F.lit(rank).alias("rank"), (1.0 / (rank + 1) * F.lit(0.9)).alias("score"))
    k = F.col("o_orderkey")
    hits = q.where("o_orderkey % 9 > 0").select(k.alias("id"), F.explode(F.array(near("case", k + 1, 1), near("case", k + 2, 2), near("case", k + 5, 3), near("strategy", k % 25, 1), near("strategy", (k * 7 + 3) % 25, 2))).alias("h")).select("id", "h.*")
    f = A.alignment_features(A.read_questions(q, "o_orderkey", "q"), cases, strategies, hits)
    return f.select("id", F.explode("features").alias("name", "value")).select("id", "name", F.round("value", 6).alias("value"))


QUERIES = {"l1_sparse_vectors": l1, "l1_dictionary": l1_dictionary, "l8_inner_table": l8_table, "l8_nested_policy": l8_policy, "l8_conservative_choice": l8_choice, "l10_alignment_features": l10}

_ENTRIES = """li AS (SELECT l_orderkey AS o_orderkey, count(*)::DOUBLE AS n, sum(l_quantity) AS q, max(l_discount) AS d, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS r FROM lineitem GROUP BY ALL), x AS (SELECT * FROM orders LEFT JOIN li USING (o_orderkey)),
e AS (SELECT o_orderkey AS id, 'q_price' AS name, o_totalprice / 1e5 AS value FROM x UNION ALL SELECT o_orderkey, 'q_month', month(o_orderdate) FROM x UNION ALL SELECT o_orderkey, 'q_lines', coalesce(n, 0) FROM x UNION ALL SELECT o_orderkey, 'status_' || o_orderstatus, 1 FROM x
UNION ALL SELECT o_orderkey, 'priority_' || o_orderpriority, 1 FROM x UNION ALL SELECT o_orderkey, 'day_' || day(o_orderdate), 1 FROM x UNION ALL
SELECT * FROM (SELECT o_orderkey, 'ratio_likelihood', o_orderkey % 7 / 7.0::DOUBLE AS v FROM x UNION ALL SELECT o_orderkey, 'table_heavy_reasoning', coalesce(q, 0) / 50 FROM x UNION ALL SELECT o_orderkey, 'case_applicability', o_orderkey % 11 / 11.0::DOUBLE FROM x
UNION ALL SELECT o_orderkey, 'strategy_applicability', d FROM x UNION ALL SELECT o_orderkey, 'ambiguity_risk', o_orderkey % 13 / 13.0::DOUBLE FROM x UNION ALL SELECT o_orderkey, 'case_copy_risk', r FROM x) WHERE v <> 0),
k AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS index FROM (SELECT DISTINCT name FROM e WHERE value IS NOT NULL))"""
_ROLES = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _ROLE) + "], lambda r: r IS NOT NULL))"
_YEARS = r"least(2, len(regexp_extract_all(y, '\b(?:19|20)[0-9][0-9]\b')))"
_JACCARD = "CASE WHEN len(q.roles) + len(x.roles) = 0 THEN 1 ELSE len(list_intersect(q.roles, x.roles)) / len(list_distinct(list_concat(q.roles, x.roles)))::DOUBLE END"
_AGREE = "(f = q.fam OR (f IN ('percentage_change', 'difference') AND q.fam IN ('percentage_change', 'difference')) OR (f IN ('ratio', 'average') AND q.fam IN ('ratio', 'average')) OR (f IN ('aggregation', 'average') AND q.fam IN ('aggregation', 'average')) OR (f IN ('unit_scaling', 'multiplication') AND q.fam IN ('unit_scaling', 'multiplication')) OR (f IN ('multi_step', 'percentage_change', 'difference', 'ratio') AND q.fam IN ('multi_step', 'percentage_change', 'difference', 'ratio')))::INT::DOUBLE"
_HELD = lambda *w: "(" + " OR ".join(f"contains(y, '{x}')" for x in w) + ")"
_SHARE = lambda col: f"list_transform(list_distinct({col}), lambda v: len(list_filter({col}, lambda u: u = v)) / len({col})::DOUBLE)"
_MODE = lambda col: f"coalesce(list_max({_SHARE(col)}), 0)"
_ENTROPY = lambda col: f"coalesce(0 - list_sum(list_transform({_SHARE(col)}, lambda p: p * ln(p + 1e-12))), 0)"
_AVG, _TOP = (lambda col: f"coalesce(list_avg({col}), 0)"), (lambda col: f"coalesce({col}[1], 0)")
_ANY = lambda col: f"coalesce(list_max({col}), 0) > 0"
_NUMBERS = {
    "pred_family_is_ratio_like": "(fam IN ('ratio', 'average'))::INT", "pred_family_is_change_like": "(fam IN ('percentage_change', 'difference'))::INT", "pred_family_is_scale_like": "(fam IN ('unit_scaling', 'multiplication'))::INT",
    "query_role_count": "CASE WHEN list_contains(roles, 'count') THEN 1 ELSE len(roles) END", "case_pred_family_top1_agree": _TOP("ca"), "case_pred_family_any_agree": f"({_ANY('ca')})::INT", "case_pred_family_agree_ratio": _AVG("ca"),
    "strategy_pred_family_any_agree": f"({_ANY('sa')})::INT", "strategy_pred_family_agree_ratio": _AVG("sa"), "case_strategy_pred_family_both_agree": f"({_ANY('ca')} AND {_ANY('sa')})::INT", "case_strategy_family_disagreement": "(ctop <> stop)::INT",
    "case_role_overlap_top1": _TOP("co"), "case_role_overlap_mean": _AVG("co"), "strategy_role_overlap_mean": _AVG("so"), "case_year_compat_top1": _TOP("cy"), "case_year_compat_mean": _AVG("cy"), "case_symbolic_compat_top1": _TOP("ca"), "case_symbolic_compat_mean": _AVG("ca"),
    "case_step_distance_top1": f"abs({_TOP('cn')} - greatest(1, len(roles) / 2.5::DOUBLE))", "case_step_entropy_proxy": "coalesce(list_stddev_pop(cn), 0)", "case_struct_mode_share": _MODE("ct"), "case_family_mode_share": _MODE("cf"), "strategy_struct_mode_share": _MODE("st"), "strategy_family_mode_share": _MODE("sf"),
    "case_struct_entropy_31": _ENTROPY("ct"), "case_family_entropy_31": _ENTROPY("cf"), "strategy_struct_entropy_31": _ENTROPY("st"), "strategy_family_entropy_31": _ENTROPY("sf"),
    "query_scale_asks_or_outputs_percent": "pct::INT", "query_scale_fraction_convention": "frac::INT", "query_scale_raw_number_convention": "(NOT frac)::INT", "query_scale_has_million": "contains(y, 'million')::INT", "query_scale_has_billion": "contains(y, 'billion')::INT",
    "query_scale_has_thousand": "contains(y, 'thousand')::INT", "query_scale_has_basis_points": "contains(y, 'basis point')::INT", "query_scale_has_scale_word": "word::INT",
    "case_scale_mismatch_top1": _TOP("cm"), "case_scale_mismatch_mean": _AVG("cm"), "strategy_scale_mismatch_mean": _AVG("sm"), "case_strategy_scale_disagreement": "coalesce(cr[1] <> sr[1], false)::INT",
    "scale_pollution_risk_case_fraction_for_percent_query": "(pct AND coalesce(cr[1], false))::INT", "scale_pollution_risk_strategy_fraction_for_percent_query": "(pct AND coalesce(sr[1], false))::INT",
    "case_top_conflict_with_rest": "coalesce(len(cf) > 1 AND len(list_filter(cf, lambda v: v = ctop)) = 1, false)::INT", "strategy_top_conflict_with_rest": "coalesce(len(sf) > 1 AND len(list_filter(sf, lambda v: v = stop)) = 1, false)::INT",
    "case_score_x_pred_family_agree": f"{_TOP('cs')} * {_TOP('ca')}", "strategy_score_x_pred_family_agree": f"{_TOP('ss')} * ({_ANY('sa')})::INT", "case_score_x_role_overlap": f"{_TOP('cs')} * {_TOP('co')}",
    "retrieval_alignment_high_conf": f"({_ANY('ca')} AND {_ANY('sa')} AND {_AVG('co')} >= 0.25 AND {_AVG('cm')} < 0.75)::INT", "retrieval_alignment_low_conf": f"(NOT ({_ANY('ca')}) AND NOT ({_ANY('sa')}) AND {_AVG('co')} < 0.2)::INT",
}
_TEXT_LIST = "[" + ", ".join(f"'{t}'" for t in _TEXTS) + "]"
_ALIGNED_SQL = f"""WITH {_Q}, qn AS (SELECT o_orderkey AS id, y, {_SECOND} AS fam, {_ROLES} AS roles, {_YEARS} AS years, regexp_matches(y, '%|percent') AS pct, regexp_matches(y, 'fraction|0-1') AS frac, regexp_matches(y, 'million|billion|thousand|basis point') AS word FROM y),
cs AS (SELECT o_orderkey AS src, (['percentage_change', 'ratio', 'average', 'aggregation', 'comparison', 'multiplication', 'other'])[o_orderkey % 7 + 1] AS f, (['subtract>divide', 'divide', 'table_average', 'add', 'greater', 'multiply', ''])[o_orderkey % 7 + 1] AS struct, ([2, 1, 1, 1, 1, 1, 0])[o_orderkey % 7 + 1]::DOUBLE AS steps,
{_ROLES} AS roles, {_YEARS} AS years, regexp_matches(lower(q || ' ' || a), '%|percent') AS pct, regexp_matches(lower(q || ' ' || a), 'fraction|0-1') OR regexp_matches(lower(a), '\\b0[.][0-9]') AS frac, regexp_matches(lower(q || ' ' || a), 'million|billion|thousand|basis point') AS word FROM y),
n AS (SELECT n_nationkey AS src, ({_TEXT_LIST})[n_nationkey % 7 + 1] AS y, ' ' || ({_TEXT_LIST})[n_nationkey % 7 + 1] || ' ' AS z, n_nationkey * 3 % 7 + 1 AS p, CASE WHEN n_nationkey % 2 = 0 THEN 'percent' ELSE '' END AS scale FROM nation),
sn AS (SELECT src, list_sort(list_distinct(list_filter([(['percentage_change', 'ratio', 'average', 'aggregation', 'comparison', 'multiplication', 'other'])[p], CASE WHEN {_HELD("change", "growth", "increase", "decrease", "cumulative return")} THEN 'percentage_change' END, CASE WHEN {_HELD("average", "mean")} THEN 'average' END, CASE WHEN {_HELD("sum", "total", "aggregate")} THEN 'aggregation' END, CASE WHEN {_HELD("part", "whole", "share", "portion", "ratio")} THEN 'ratio' END], lambda v: v IS NOT NULL))) AS fs,
(['subtract>divide', 'divide', 'table_average', 'add', 'greater', 'multiply', ''])[p] AS struct, {_ROLES} AS roles, regexp_matches(y || ' ' || scale, '%|percent') AS pct, regexp_matches(y, 'fraction|0-1') AS frac, regexp_matches(y, 'million|billion|thousand|basis point') AS word FROM n),
ch AS (SELECT q.id, rank, x.f AS f, x.struct, x.steps, {_JACCARD} AS o, (q.years = x.years)::INT::DOUBLE AS yy, (q.pct <> x.pct OR (q.word AND NOT x.word))::INT::DOUBLE AS m, x.frac AS r, 0.9 / (rank + 1) AS s, {_AGREE} AS a FROM qn q, (VALUES (1, 1), (2, 2), (3, 5)) v(rank, d) JOIN cs x ON x.src = q.id + d WHERE q.id % 9 > 0),
sh AS (SELECT q.id, rank, x.fs, x.struct, {_JACCARD} AS o, (q.pct <> x.pct OR (q.word AND NOT x.word))::INT::DOUBLE AS m, x.frac AS r, 0.9 / (rank + 1) AS s, list_transform(x.fs, lambda f: {_AGREE}) AS a FROM qn q, (VALUES (1, 1, 0), (2, 7, 3)) v(rank, k, d) JOIN sn x ON x.src = (q.id * k + d) % 25 WHERE q.id % 9 > 0),
c AS (SELECT id, list(f ORDER BY rank) AS cf, list(struct ORDER BY rank) AS ct, list(steps ORDER BY rank) AS cn, list(o ORDER BY rank) AS co, list(yy ORDER BY rank) AS cy, list(m ORDER BY rank) AS cm, list(r ORDER BY rank) AS cr, list(s ORDER BY rank) AS cs, list(a ORDER BY rank) AS ca FROM ch GROUP BY id),
st AS (SELECT id, flatten(list(fs ORDER BY rank)) AS sf, list(struct ORDER BY rank) AS st, list(o ORDER BY rank) AS so, list(m ORDER BY rank) AS sm, list(r ORDER BY rank) AS sr, list(s ORDER BY rank) AS ss, flatten(list(a ORDER BY rank)) AS sa FROM sh GROUP BY id),
w AS (SELECT *, coalesce(cf[1], 'none') AS ctop, coalesce(sf[1], 'none') AS stop FROM qn q LEFT JOIN c USING (id) LEFT JOIN st USING (id)),
e AS (SELECT id, unnest(list_concat([{", ".join(f"{{'name': '{k}', 'value': ({v})::DOUBLE}}" for k, v in _NUMBERS.items())}, {{'name': 'pred_family_' || fam, 'value': 1.0::DOUBLE}}, {{'name': 'case_top_pred_family_' || ctop, 'value': 1.0::DOUBLE}}, {{'name': 'strategy_top_pred_family_' || stop, 'value': 1.0::DOUBLE}}], list_transform(list_filter(roles, lambda r: r <> 'count'), lambda r: {{'name': 'query_role_' || r, 'value': 1.0::DOUBLE}}))) AS e FROM w)
SELECT id, e.name AS name, round(e.value, 6) + 0.0 AS value FROM e"""
ORACLES = {
    "l1_sparse_vectors": f"WITH {_ENTRIES} SELECT id, string_agg(index::VARCHAR, ',' ORDER BY index) AS indices, round(sum(value), 6) AS total FROM e JOIN k USING (name) WHERE value IS NOT NULL GROUP BY id",
    "l1_dictionary": f"WITH {_ENTRIES} SELECT name, index FROM k",
    "l8_conservative_choice": f"""WITH {ARMS_SQL}, p AS (SELECT sample_id AS id, any_value(cust) AS cust, avg(correct::INT) FILTER (arm = 'none') AS p_none, avg(correct::INT) FILTER (arm = 'case') AS p_case, avg(correct::INT) FILTER (arm = 'strategy') AS p_strategy, avg(correct::INT) FILTER (arm = 'both') AS b FROM arms GROUP BY sample_id),
c(number, arm, threshold) AS (VALUES (0, 'none', 0.0), (1, 'none', 0.3), (2, 'none', 0.7), (3, 'case', 0.0), (4, 'case', 0.3), (5, 'case', 0.7), (6, 'strategy', 0.0), (7, 'strategy', 0.3), (8, 'strategy', 0.7)),
y AS (SELECT id % 4 AS f, cust % 3 AS g, number, threshold, id % 10 < threshold * 10 AS l, CASE WHEN id % 10 < threshold * 10 THEN CASE arm WHEN 'none' THEN p_none WHEN 'case' THEN p_case ELSE p_strategy END ELSE b END AS v, b FROM p, c),
d AS (SELECT f, g, number, threshold, avg(v) - avg(b) AS gain, avg(l::INT) AS cov FROM y GROUP BY ALL),
t AS (SELECT f, number, threshold, round(avg(gain), 12) AS m, round(coalesce(stddev_samp(gain) / sqrt(count(*)), 0), 12) AS se, avg(cov) AS cov FROM d GROUP BY ALL),
u AS (SELECT *, first_value(m - se) OVER (PARTITION BY f ORDER BY m DESC, number) AS cutoff FROM t)
SELECT f, number, round(m, 9) AS mean_gain, round(cov, 9) AS coverage FROM u WHERE m >= cutoff - 1e-12 QUALIFY row_number() OVER (PARTITION BY f ORDER BY cov, threshold = 0 DESC, threshold DESC, m DESC, number) = 1""",
    "l10_alignment_features": _ALIGNED_SQL,
}
