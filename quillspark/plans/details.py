"""Queries of schema keys, rule sets, profiles, folds, set checks, renderings and corruptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as N
from ..functions import programs as P
from ..functions import rules as K
from ..functions import text as X
from ..operators import abstractions as B
from ..operators import integrity as M
from ..operators import metrics as E
from ..operators import outcomes as O
from ..operators import rendering as R
from ..operators import retrieval as V
from ..operators import tables as T
from ..shipping import ship
from .evaluation import _LINEAR, _ORDERS, _TABLE, _case, _case_sql, _orders, _table
from .outcomes import _q, arms
from .outcomes import _sql as arms_sql

_ASKED = ("What is the growth rate in 2018 and 2019?", "Which year had the highest price of {t}?", "Is {t} greater than {c}?", "What is the total of {t} million?", "How many percent of {t} per unit?", "What was the change in {t}?", "Name the order", "What is the average price, {c}?")


def _asked(spark, sf_dir):
    return _orders(spark, sf_dir).withColumn("q", _case(*_ASKED)).withColumn("program", F.when(F.col("k") < 4, _case(*_LINEAR)))


def h14(spark, sf_dir):
    key = P.schema_key(F.col("program"), F.col("q"), F.concat_ws(", ", F.col("t").cast("string"), F.when(F.col("c") % 2 == 0, F.col("c").cast("string"))), F.col("c") % 2, F.col("c") % 3, K.scale_hint(F.col("q")))
    o = _asked(spark, sf_dir).withColumn("m", P.split_key(key)).withColumn("key", key)
    return o.groupBy("key", F.col("m")["family"].alias("family"), F.col("m")["ev"].alias("ev"), F.col("m")["scale"].alias("scale")).agg(F.count("*").alias("n"))


def h13(spark, sf_dir):
    t = _table(spark, sf_dir).withColumn("ops", P.known_operations(F.col("program"))).withColumn("a", P.op_family(F.col("ops"))).withColumn("b", P.aligned_family(F.col("ops")))
    return t.groupBy("a", "b", P.compatible(F.col("b"), F.lit("difference")).alias("like_difference"), F.array_join(P.operation_set(F.col("program")), ",").alias("set")).agg(F.count("*").alias("n"))


def h4b(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("What did "), F.col("c_name"), F.lit(" of the "), F.lower("c_mktsegment"), F.lit(" segment owe in 2019, above 500?"))
    return c.groupBy(X.entity_template(text, F.array("c_mktsegment", "c_name")).alias("template")).agg(F.count("*").alias("n"))


def h23(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "R"), "n/a").otherwise(F.concat(F.lit("$"), F.col("l_quantity").cast("long").cast("string"))).alias("v")))).alias("r"))  # seven lines at most
    n = N.row_numbers(F.transform("r", lambda x: x["v"]))
    return li.select("l_orderkey", F.aggregate(n, F.lit(0.0), lambda s, v: s + v).alias("total"))


def h35(spark, sf_dir):
    """One-hot maps, clamped maps and coerced lists."""
    m = A.one_hot(k=F.col("k"), odd=F.when(F.col("t") % 2 == 1, F.lit("yes")))
    c = A.clamped(F.create_map(F.lit("p"), (F.col("c") % 30) / 10.0, F.lit("other"), F.lit(3.0)), {"p": (0.5, 2.0)})
    items = A.as_list(_case('["{t}", "x"]', "{t}", "", "[broken"))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("hot"), c["p"].alias("p"), F.size(c).cast("long").alias("kept"), F.array_join(items, "|").alias("items"))


def h41(spark, sf_dir):
    gold, pred = F.col("c").cast("double"), F.when(F.col("k") % 2 == 0, F.col("c") / 100.0).otherwise(F.col("c") * 1.0005)
    return _asked(spark, sf_dir).groupBy((F.col("k") % 8).alias("form"), N.percent_context(F.col("q")).alias("percent"), N.context_match(pred, gold, N.percent_context(F.col("q"))).alias("same")).agg(F.count("*").alias("n"))


def d19(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = T.split_profile(d, ["text", "source"], {"length": F.length("text") == F.col("n_chars"), "long": F.col("n_chars") > 1000}, "lang")
    return p.select("lang", "rows", "missing_text", "missing_source", "valid_length", "valid_long", F.round("rate_long", 9).alias("rate_long"))


def d33(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").cast("long").alias("rank"), F.col("l_suppkey").alias("source_id")).distinct()
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 20").select(F.col("s_suppkey").alias("source_id"), (F.col("s_nationkey") % 10).alias("key"))
    targets = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("target_id"), (F.col("c") % 12).alias("key"))
    h = V.hit_rates(li, targets, sup, "key")
    return h.select("targets", "eligible", *(F.round(c, 9).alias(c) for c in ("top_1", "top_k", "eligible_top_1", "eligible_top_k")))


def d32(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = V.leading_dims(V.centroids(e, "label", "embedding"), "label", "centroid", 3)
    return v.select("label", *(F.round(c, 6).alias(c) for c in ("d0", "d1", "d2")))


def f8b(spark, sf_dir):
    o = T.top_structures(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("struct", F.concat_ws(">", "o_orderstatus", "o_orderpriority")), "struct", 6)
    return T.first_per(T.first_per(o, "o_custkey", "o_orderkey", 1, "company"), "struct", "o_orderkey", 3, "struct").select("struct", "o_orderkey")


def f4(spark, sf_dir):
    return T.first_n(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 1"), "o_orderkey", 25).select("o_orderkey")


def g2(spark, sf_dir):
    """Set checks as faults: shared, repeated, missing and extra ids."""
    o = _orders(spark, sf_dir).select("o_orderkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    few = o.where("o_orderkey % 10 < 7")
    parts = [T.shared_ids(few, li, "o_orderkey").select(F.lit("shared").alias("fault")), T.repeated_ids(li, "o_orderkey").select(F.lit("repeated").alias("fault")), T.set_differences(few, li, "o_orderkey").select(F.col("side").alias("fault"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("fault").agg(F.count("*").alias("n"))


def l3b(spark, sf_dir):
    """Shuffled and stratified folds: sizes differ by one row at most, in every stratum."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    p = T.shuffled_folds(o, "o_orderkey", 5, "plain").groupBy("fold").agg(F.count("*").alias("n")).select(F.lit("shuffled").alias("kind"), F.lit("").alias("stratum"), "n")
    s = T.shuffled_folds(o, "o_orderkey", 5, "strata", "o_orderstatus").groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n")).select(F.lit("stratified").alias("kind"), F.col("o_orderstatus").alias("stratum"), "n")
    return p.unionByName(s).groupBy("kind", "stratum").agg(F.sum("n").alias("rows"), (F.max("n") - F.min("n") <= 1).alias("even"))


def _drift(spark, sf_dir):
    text = _case("Divide the current amount by the prior one, then multiply by 100", "Take the numerator and divide by the denominator in percent", "add the first to the second", "nothing to see")
    kind = F.element_at(F.array(*map(F.lit, ("scale", "operation", "operand_role"))), (F.col("c") % 3 + 1).cast("int"))
    return _orders(spark, sf_dir).withColumn("text", text).withColumn("kind", kind)


def m8b(spark, sf_dir):
    d = _drift(spark, sf_dir)
    return d.withColumn("x", M.corrupted(F.lower("text"), F.col("kind"))).groupBy((F.col("k") % 4).alias("form"), "kind", "x.text", "x.mutation").agg(F.count("*").alias("n"))


def m7(spark, sf_dir):
    ops = F.when(F.col("k") % 2 == 0, F.array(F.lit("divide"), F.lit("multiply"))).otherwise(F.array(F.lit("divide")))
    i = B.quality_issues(ops, F.concat("text", F.when(F.col("c") % 2 == 0, " and divide by 100").otherwise("")), F.lit("in percent"))
    return _drift(spark, sf_dir).groupBy((F.col("k") % 4).alias("form"), (F.col("c") % 2).alias("odd"), F.array_join(i, ",").alias("issues")).agg(F.count("*").alias("n"))


def m4b(spark, sf_dir):
    o = _orders(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"), "c_name", "c_mktsegment"), "c")
    text = F.concat_ws(" ", F.lit("Use the ratio"), F.when(F.col("k") == 0, F.upper("c_name")), F.when(F.col("k") == 1, "of 2019"), F.when(F.col("k") == 2, F.col("t").cast("string")), F.when(F.col("k") < 5, F.lower("c_mktsegment")))
    return M.case_leaks(o.withColumn("text", text), "o_orderkey", "text", F.col("c_name"), F.col("t").cast("string"), F.array("c_mktsegment")).groupBy("check").agg(F.count("*").alias("n"))


def m2b(spark, sf_dir):
    """A release's checks in one report, also those without a fault."""
    o, li = _orders(spark, sf_dir), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = li.select(F.col("l_orderkey").alias("o_orderkey"))
    return M.release_report({"order_without_lines": o.join(lines, "o_orderkey", "left_anti").select("o_orderkey"), "line_without_order": lines.join(o, "o_orderkey", "left_anti"), "dear_order": o.where("t > 300000").select("o_orderkey"), "repeated_order": T.repeated_ids(o, "o_orderkey").select("o_orderkey")}, {"regions": (spark.read.parquet(f"{sf_dir}/region.parquet"), 5), "nations": (spark.read.parquet(f"{sf_dir}/nation.parquet"), 24)})


def m13b(spark, sf_dir):
    gold = F.col("t") / 2
    a, b = F.col("t") / F.when(F.col("k") < 4, 2).otherwise(3), F.when(F.col("k") % 4 == 0, gold).when(F.col("k") % 4 == 1, gold + 1).otherwise(F.col("t") / 3)
    near = lambda x: F.abs(x - gold)
    return _orders(spark, sf_dir).groupBy(O.graded_change(near(a) < 1e-6, near(b) < 1e-6, near(a), near(b)).alias("outcome")).agg(F.count("*").alias("n"))


def n1b(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.array(F.col("l_linenumber").cast("string"), F.concat(F.col("l_returnflag"), F.lit(', "x"')), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("long").cast("string")).otherwise("")))).alias("r"))  # seven lines at most
    t = F.concat(F.array(F.array(F.lit("line"), F.lit("flag"), F.lit("quantity"))), F.col("r"))
    return li.select("l_orderkey", R.table_csv(t).alias("csv"), F.md5(R.table_sentences(t).cast("binary")).alias("sentences"), R.retrieval_text(F.lit("How many?"), F.lit("sum"), t, True).alias("memory"))


def n4b(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws(":", "lang", "source").alias("key"))
    g = R.top_groups(d, "key", "doc_id", 4, 3)
    return g.select("key", "support", "prototype", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def n6b(spark, sf_dir):
    a = arms(spark, sf_dir)
    p = R.arm_prompt(F.col("arm"), F.concat(F.lit("q"), F.col("sample_id").cast("string")), F.lit("ctx"), F.lit("c1"), F.lit("s1"))
    return a.select("arm", "replicate", p.alias("p")).groupBy("arm").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


def o2b(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("model", F.when(F.col("k") == 0, None).otherwise("m-1")).withColumn("temperature", F.when(F.col("k") == 1, 0.5).otherwise(0.0))
    return M.usable(o, {"model": "m-1", "temperature": 0.0}).groupBy("hit").agg(F.count("*").alias("n"))


def j18b(spark, sf_dir):
    """Execution and program accuracy of predictions against gold programs."""
    ship(spark)
    o = _orders(spark, sf_dir).withColumn("gold", P.parse_nested(_case("add(multiply(2, {t}), 7)", "subtract({t}, 7)", "add({t}, {t})", "multiply({t}, 2)")))
    o = o.withColumn("pred", P.parse_nested(_case("add(7, multiply({t}, 2))", "subtract(7, {t})", "multiply({t}, 2)", "multiply({t}, 2")))
    value = lambda c: P.answer(P.execute(F.col(f"{c}.steps")))
    o = o.withColumn("exe", F.coalesce(N.same_at(value("pred"), value("gold")), F.lit(False))).withColumn("prog", F.coalesce(P.canonical_form(F.col("pred.steps")) == P.canonical_form(F.col("gold.steps")), F.lit(False)))
    return o.groupBy((F.col("k") % 4).alias("form")).agg(F.count("*").alias("n"), F.count_if("exe").alias("execution"), F.count_if("prog").alias("program"))


def k4(spark, sf_dir):
    """The best of several golds for each answer."""
    ship(spark)
    o = _orders(spark, sf_dir).withColumn("g", F.explode(F.array(F.array(F.lit("net sales")), F.array(F.lit("gross sales of the year")), F.array(F.col("t").cast("string")))))
    m = E.qa(F.col("g"), F.lit(""), F.lit("span"), F.array(_case("sales", "{t}", "the net sales", "cash")), F.lit(""))
    b = o.withColumn("m", m).groupBy("o_orderkey", "k").agg(F.max(F.struct("m.em", "m.f1")).alias("b"))
    return b.groupBy((F.col("k") % 4).alias("form"), "b.em", "b.f1").agg(F.count("*").alias("n"))


def d13(spark, sf_dir):
    ship(spark)
    o = _orders(spark, sf_dir).select("k", E.qa(F.array(F.col("t").cast("string")), _case("", "million"), _case("arithmetic", "span", "count"), F.array(_case("{t}", "{c}")), _case("", "thousand", "million")).alias("m")).withColumn("kind", F.element_at(F.array(*map(F.lit, ("arithmetic", "span", "count"))), (F.col("k") % 3 + 1).cast("int")))
    return E.grouped(o.select("kind", "m.*"), "kind").select("kind", "n", F.round("mean_em", 9).alias("mean_em"), (F.col("sum_f1") >= F.col("sum_em")).alias("f1_at_least_em"))


QUERIES = {"d13_grouped_metrics": d13, "d19_split_profile": d19, "d22_largest_share": _q(lambda a: O.largest_share(a.where("correct and arm <> 'none'"), "cust")), "d23_stable_marginals": _q(O.stable_marginals), "d26_disagreement": _q(O.disagreement), "d32_leading_dims": d32, "d33_hit_rates": d33, "f4_first_n": f4, "f8_top_structures": f8b, "g2_set_faults": g2, "h4_entity_templates": h4b, "h13_aligned_families": h13, "h14_schema_keys": h14, "h23_row_numbers": h23, "h35_maps_and_lists": h35, "h41_percent_context": h41, "j18_accuracies": j18b, "k4_best_gold": k4, "l3_shuffled_folds": l3b, "m2_release_report": m2b, "m4_case_leaks": m4b, "m7_quality_issues": m7, "m8_corrupted": m8b, "m13_graded_change": m13b, "n1_table_forms": n1b, "n4_top_groups": n4b, "n6_arm_prompts": n6b, "o2_usable_cache": o2b}
_A = f"a AS (SELECT *, {_case_sql(*_ASKED)} AS q, lower({_case_sql(*_ASKED)}) AS l, CASE WHEN k < 4 THEN {_case_sql(*_LINEAR)} END AS program FROM o)"
_RATIO, _SUM, _SUPER, _COMP = (r.replace("'", "''") for r in (P.RATIO_WORDS, P.SUM_WORDS, P.SUPERLATIVES, P.COMPARED))
ORACLES = {
    "d13_grouped_metrics": f"WITH {_ORDERS}, m AS (SELECT (['arithmetic', 'span', 'count'])[k % 3 + 1] AS kind, (CASE WHEN k % 2 = 0 THEN k % 3 <> 1 AND (k % 3 = 0 OR t = 0) WHEN k % 3 = 1 THEN false ELSE c * CASE k % 3 WHEN 0 THEN 1 ELSE 1000000 END = t * 1000000 END)::INT AS em FROM o) SELECT kind, count(*) AS n, round(avg(em), 9) AS mean_em, true AS f1_at_least_em FROM m GROUP BY ALL",
    "d19_split_profile": "SELECT lang, count(*) AS rows, count(*) FILTER (text IS NULL OR trim(text) = '') AS missing_text, count(*) FILTER (source IS NULL OR trim(source) = '') AS missing_source, count(*) FILTER (length(text) = n_chars) AS valid_length, count(*) FILTER (n_chars > 1000) AS valid_long, round(count(*) FILTER (n_chars > 1000) / count(*)::DOUBLE, 9) AS rate_long FROM documents GROUP BY ALL",
    "d22_largest_share": arms_sql(", g AS (SELECT cust, count(*) AS c FROM arms WHERE correct AND arm <> 'none' GROUP BY ALL) SELECT sum(c)::BIGINT AS events, count(*) AS groups, round(max(c) / sum(c)::DOUBLE, 9) AS top_share FROM g"),
    "d23_stable_marginals": arms_sql(", e AS (SELECT replicate, unnest([('none', none_), ('case', case_), ('strategy', strategy_)]) AS x, both_ FROM wide), n AS (SELECT x[1] AS arm, replicate, avg(x[2]::INT - both_::INT) AS net FROM e GROUP BY ALL) SELECT arm, round(min(net), 9) AS least, round(max(net), 9) AS greatest, min(net) > 0 OR max(net) < 0 AS stable FROM n GROUP BY arm"),
    "d26_disagreement": arms_sql(", p AS (SELECT a.arm, a.sample_id, (a.correct <> b.correct)::INT AS d FROM arms a JOIN arms b ON a.arm = b.arm AND a.sample_id = b.sample_id AND a.replicate < b.replicate), s AS (SELECT arm, sample_id, max(d) AS any_d FROM p GROUP BY ALL) SELECT arm, round((SELECT avg(any_d) FROM s WHERE s.arm = p.arm), 9) AS any_change, round(avg(d), 9) AS pairwise FROM p GROUP BY arm"),
    "d32_leading_dims": "SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS d0, round(avg(embedding[2]::DOUBLE), 6) AS d1, round(avg(embedding[3]::DOUBLE), 6) AS d2 FROM embeddings GROUP BY label",
    "d33_hit_rates": "WITH s AS (SELECT s_suppkey, s_nationkey % 10 AS key FROM supplier WHERE s_nationkey < 20), t AS (SELECT o_orderkey, o_custkey % 12 AS key FROM orders), b AS (SELECT t.o_orderkey, t.key IN (SELECT key FROM s) AS e, min(l_linenumber) FILTER (s.key = t.key) AS best FROM t LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 4 LEFT JOIN s ON s_suppkey = l_suppkey GROUP BY ALL) SELECT count(*) AS targets, count(*) FILTER (e) AS eligible, round(avg(coalesce(best <= 1, false)::INT), 9) AS top_1, round(avg(coalesce(best <= 3, false)::INT), 9) AS top_k, round(avg(coalesce(best <= 1, false)::INT) FILTER (e), 9) AS eligible_top_1, round(avg(coalesce(best <= 3, false)::INT) FILTER (e), 9) AS eligible_top_k FROM b",
    "f4_first_n": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 ORDER BY o_orderkey LIMIT 25",
    "f8_top_structures": "WITH o AS (SELECT *, o_orderstatus || '>' || o_orderpriority AS struct FROM orders), b AS (SELECT struct FROM o GROUP BY struct ORDER BY count(*) DESC, struct LIMIT 6), c AS (SELECT * FROM o WHERE struct IN (FROM b) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('company|' || o_orderkey), o_orderkey) = 1) SELECT struct, o_orderkey FROM c QUALIFY row_number() OVER (PARTITION BY struct ORDER BY sha256('struct|' || o_orderkey), o_orderkey) <= 3",
    "g2_set_faults": "WITH f AS (SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 10 < 7), l AS (SELECT l_orderkey AS i FROM lineitem WHERE l_linenumber = 2), x AS (SELECT 'shared' AS fault, count(*) AS n FROM f WHERE i IN (FROM l) UNION ALL SELECT 'repeated', count(*) FROM (SELECT i FROM l GROUP BY i HAVING count(*) > 1) UNION ALL SELECT 'missing', count(*) FROM f WHERE i NOT IN (FROM l) UNION ALL SELECT 'extra', count(DISTINCT i) FROM l WHERE i NOT IN (FROM f)) SELECT * FROM x WHERE n > 0",
    "h4_entity_templates": "SELECT 'what did <entity> of the <entity> segment owe in <year>, above <num>?' AS template, count(*) AS n FROM customer",
    "h13_aligned_families": f"WITH {_TABLE}, x AS (SELECT list_filter(regexp_extract_all(program, '([a-z_]+)\\(', 1), lambda v: v <> 'none') AS ops FROM p), y AS (SELECT CASE WHEN list_contains(ops, 'greater') THEN 'comparison' WHEN len(list_filter(ops, lambda v: starts_with(v, 'table_'))) > 0 THEN 'table_aggregation' WHEN list_has_all(ops, ['divide', 'subtract']) THEN 'change' WHEN list_contains(ops, 'divide') THEN 'ratio' WHEN list_contains(ops, 'add') THEN 'aggregation' WHEN list_contains(ops, 'multiply') THEN 'scaling' ELSE 'other' END AS a, CASE WHEN list_contains(ops, 'greater') THEN 'comparison' WHEN list_contains(ops, 'table_average') THEN 'average' WHEN len(list_filter(ops, lambda v: starts_with(v, 'table_'))) > 0 THEN 'aggregation' WHEN list_has_all(ops, ['divide', 'subtract']) THEN 'percentage_change' WHEN list_contains(ops, 'divide') THEN 'ratio' WHEN list_contains(ops, 'subtract') THEN 'difference' WHEN list_contains(ops, 'add') THEN 'aggregation' WHEN list_contains(ops, 'multiply') THEN 'multiplication' ELSE 'other' END AS b, array_to_string(list_sort(list_distinct(list_concat(ops, list_transform(ops, lambda v: replace(v, 'table_', ''))))), ',') AS \"set\" FROM x) SELECT a, b, b IN ('difference', 'percentage_change', 'ratio', 'multi_step') AS like_difference, \"set\", count(*) AS n FROM y GROUP BY ALL",
    "h14_schema_keys": f"""WITH {_ORDERS}, {_A}, x AS (SELECT k, c, l, regexp_extract_all(program, '([a-z_]+)\\(', 1) AS ops, CASE WHEN regexp_matches(l, 'percent|%') THEN 'percent' WHEN contains(l, 'million') THEN 'million' ELSE 'none' END AS scale, CASE WHEN c % 2 > 0 AND c % 3 > 0 THEN 'text+table' WHEN c % 2 > 0 THEN 'text' WHEN c % 3 > 0 THEN 'table' ELSE 'none' END AS ev FROM a),
y AS (SELECT *, CASE k WHEN 0 THEN 'program:' || CASE WHEN regexp_matches(l, '{_RATIO}') THEN 'change_rate' ELSE 'difference_then_ratio' END WHEN 1 THEN 'program:sequence:table_sum' WHEN 2 THEN 'program:sequence:table_max>add' WHEN 3 THEN 'program:' || CASE WHEN regexp_matches(l, '{_RATIO}') THEN 'ratio' ELSE 'division_composition' END
ELSE 'span:' || CASE WHEN regexp_matches(l, '{_SUPER}') THEN 'superlative_lookup' WHEN regexp_matches(l, '{_COMP}') THEN 'comparison_lookup' WHEN c % 2 = 0 THEN 'multi_value_lookup' WHEN regexp_matches(l, '{_SUM}') OR regexp_matches(l, '{_RATIO}') THEN 'computed_value_lookup' ELSE 'direct_lookup' END END AS family FROM x)
SELECT concat_ws('|', CASE WHEN k < 4 THEN 'program' ELSE 'span' END, family, 'ops=' || CASE WHEN k < 4 THEN array_to_string(list_sort(list_distinct(ops)), '+') ELSE 'none' END, 'steps=' || CASE WHEN k < 4 THEN len(ops) ELSE 0 END, 'ev=' || ev, 'tables=' || CASE c % 3 WHEN 2 THEN 'multi' WHEN 1 THEN 'single' ELSE 'none' END, 'scale=' || scale) AS key, family, ev, scale, count(*) AS n FROM y GROUP BY ALL""",
    "h23_row_numbers": "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linenumber = 3 AND l_returnflag = 'R') = 0 THEN sum(l_quantity::BIGINT)::DOUBLE END AS total FROM lineitem GROUP BY ALL",
    "h35_maps_and_lists": f"WITH {_ORDERS} SELECT o_orderkey, 'k=' || k || CASE WHEN t % 2 = 1 THEN ',odd=yes' ELSE '' END AS hot, greatest(0.5::DOUBLE, least(2.0::DOUBLE, (c % 30) / 10.0::DOUBLE)) AS p, 1::BIGINT AS kept, CASE k % 4 WHEN 0 THEN t || '|x' WHEN 1 THEN t::VARCHAR WHEN 2 THEN '' ELSE '[broken' END AS items FROM o",
    "h41_percent_context": f"WITH {_ORDERS} SELECT k AS form, k = 4 AS percent, CASE WHEN k % 2 = 1 THEN true WHEN k = 4 THEN true ELSE abs(c / 100.0 - c) <= greatest(0.001, c * 0.001) END AS same, count(*) AS n FROM o GROUP BY ALL",
    "j18_accuracies": f"WITH {_ORDERS} SELECT k % 4 AS form, count(*) AS n, count(*) FILTER (k % 4 IN (0, 2) OR (k % 4 = 1 AND t = 7)) AS execution, count(*) FILTER (k % 4 = 0) AS program FROM o GROUP BY ALL",
    "k4_best_gold": f"WITH {_ORDERS} SELECT k % 4 AS form, (k % 4 IN (1, 2))::INT::DOUBLE AS em, CASE k % 4 WHEN 0 THEN 0.67 WHEN 3 THEN 0 ELSE 1 END::DOUBLE AS f1, count(*) AS n FROM o GROUP BY ALL",
    "l3_shuffled_folds": "SELECT 'shuffled' AS kind, '' AS stratum, count(*) AS rows, true AS even FROM orders UNION ALL SELECT 'stratified', o_orderstatus, count(*), true FROM orders GROUP BY o_orderstatus",
    "m2_release_report": f"WITH {_ORDERS}, v AS (SELECT 'order_without_lines' AS \"check\", o_orderkey::VARCHAR AS id FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'dear_order', o_orderkey::VARCHAR FROM o WHERE t > 300000 UNION ALL SELECT 'rows:nations', count(*)::VARCHAR FROM nation HAVING count(*) <> 24 UNION ALL SELECT 'rows:regions', count(*)::VARCHAR FROM region HAVING count(*) <> 5) SELECT n.c AS \"check\", count(id) AS faults, min(id) AS first FROM (VALUES ('order_without_lines'), ('line_without_order'), ('dear_order'), ('repeated_order'), ('rows:regions'), ('rows:nations')) n(c) LEFT JOIN v ON v.check = n.c GROUP BY n.c",
    "m4_case_leaks": f"WITH {_ORDERS}, x AS (SELECT k, c_name, t FROM o JOIN customer ON c_custkey = c), y AS (SELECT 'company' AS \"check\", count(*) AS n FROM x WHERE k = 0 UNION ALL SELECT 'year', count(*) FROM x WHERE k = 1 OR (k = 2 AND regexp_matches(t::VARCHAR, '^(19|20)[0-9]{{2}}$')) UNION ALL SELECT 'answer', count(*) FROM x WHERE k = 2 OR (k = 0 AND contains(c_name, t::VARCHAR)) OR (k = 1 AND contains('2019', t::VARCHAR)) UNION ALL SELECT 'entity', count(*) FROM x WHERE k < 5) SELECT * FROM y WHERE n > 0",
    "m7_quality_issues": f"WITH {_ORDERS}, x AS (SELECT k % 4 AS form, c % 2 AS odd FROM o) SELECT form, odd, CASE form WHEN 0 THEN CASE odd WHEN 0 THEN 'scale_conflict' ELSE '' END WHEN 1 THEN 'template_leakage' WHEN 2 THEN CASE odd WHEN 0 THEN 'missing_operation,invented_operation' ELSE 'missing_operation,invented_operation' END ELSE CASE odd WHEN 0 THEN '' ELSE 'missing_operation' END END AS issues, count(*) AS n FROM x GROUP BY ALL",
    "m8_corrupted": f"""WITH {_ORDERS}, x AS (SELECT k % 4 AS form, (['scale', 'operation', 'operand_role'])[c % 3 + 1] AS kind FROM o), y AS (SELECT form, kind, (['divide the current amount by the prior one, then multiply by 100', 'take the numerator and divide by the denominator in percent', 'add the first to the second', 'nothing to see'])[form + 1] AS s FROM x)
SELECT form, kind, CASE WHEN kind = 'scale' AND form = 0 THEN replace(s, 'multiply by 100', 'divide by 100') WHEN kind = 'scale' AND form = 1 THEN replace(s, 'percent', 'decimal') WHEN kind = 'operation' AND form < 2 THEN regexp_replace(s, 'divide', 'multiply') WHEN kind = 'operation' AND form = 2 THEN replace(s, 'add', 'subtract') WHEN kind = 'operand_role' AND form = 0 THEN 'divide the prior amount by the current one, then multiply by 100' WHEN kind = 'operand_role' AND form = 1 THEN 'take the denominator and divide by the numerator in percent' WHEN kind = 'operand_role' AND form = 2 THEN 'add the second to the first' ELSE s END AS text,
CASE WHEN kind = 'scale' AND form = 0 THEN 'multiply by 100 -> divide by 100' WHEN kind = 'scale' AND form = 1 THEN 'percent -> decimal' WHEN kind = 'operation' AND form < 2 THEN 'divide -> other' WHEN kind = 'operation' AND form = 2 THEN 'add -> other' WHEN kind = 'operand_role' AND form = 0 THEN 'current <-> prior' WHEN kind = 'operand_role' AND form = 1 THEN 'numerator <-> denominator' WHEN kind = 'operand_role' AND form = 2 THEN 'first <-> second' END AS mutation, count(*) AS n FROM y GROUP BY ALL""",
    "m13_graded_change": f"WITH {_ORDERS}, x AS (SELECT CASE WHEN k < 4 THEN 0.0::DOUBLE ELSE abs(t / 3 - t / 2) END AS a, CASE k % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 ELSE abs(t / 3 - t / 2) END AS b FROM o) SELECT CASE WHEN a >= 1e-6 AND b < 1e-6 THEN 'repaired' WHEN a < 1e-6 AND b >= 1e-6 THEN 'broken' WHEN a < 1e-6 THEN 'unchanged_right' WHEN b < a THEN 'improved' WHEN b > a THEN 'worse' ELSE 'unchanged_wrong' END AS outcome, count(*) AS n FROM x GROUP BY ALL",
    "n1_table_forms": """WITH x AS (SELECT l_orderkey, l_linenumber::VARCHAR AS l, l_returnflag || ', "x"' AS f, CASE WHEN l_quantity > 10 THEN l_quantity::BIGINT::VARCHAR ELSE '' END AS q FROM lineitem) SELECT l_orderkey, 'line,flag,quantity' || chr(10) || string_agg(l || ',"' || replace(f, '"', '""') || '",' || q, chr(10) ORDER BY l, f, q) AS csv, md5(string_agg('the flag of ' || l || ' is ' || f || CASE WHEN q <> '' THEN '; the quantity of ' || l || ' is ' || q ELSE '' END, '; ' ORDER BY l, f, q)) AS sentences, 'Question: How many?' || chr(10) || 'Rows: line; ' || string_agg(l, '; ' ORDER BY l, f, q) || chr(10) || 'Family: sum' AS memory FROM x GROUP BY l_orderkey""",
    "n4_top_groups": "SELECT lang || ':' || source AS key, count(*) AS support, min(doc_id) AS prototype, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS ids FROM documents GROUP BY ALL ORDER BY support DESC, key LIMIT 4",
    "n6_arm_prompts": arms_sql("SELECT arm, count(*) AS n, sum(66 + length(sample_id::VARCHAR) + CASE arm WHEN 'case' THEN 11 WHEN 'strategy' THEN 16 WHEN 'both' THEN 27 ELSE 0 END)::BIGINT AS chars FROM arms GROUP BY arm"),
    "o2_usable_cache": f"WITH {_ORDERS} SELECT k > 1 AS hit, count(*) AS n FROM o GROUP BY ALL",
}
