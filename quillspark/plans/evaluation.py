"""Queries of parsers, executors, answer forms and evaluators; inputs are built from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import derivations as D
from ..functions import numbers as N
from ..functions import programs as P
from ..functions import text as X
from ..operators import metrics as E
from ..operators import outcomes as O
from ..operators import stats as S
from ..shipping import ship
from .outcomes import ARMS_SQL, arms

BOOT, SEED = 10_000, 20260816


def _orders(spark, sf_dir):
    """(o_orderkey, t, k): t is the whole part of the price, k steers which form a row takes."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("t"), (F.col("o_orderkey") % 8).alias("k"), F.col("o_custkey").alias("c"))


_ORDERS = "o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS t, o_orderkey % 8 AS k, o_custkey AS c FROM orders)"


def _case(*forms):
    """One of the forms by k; text holds {t} for the price and {c} for the customer."""
    out = None
    for i, form in enumerate(forms):
        v = F.lit(None).cast("string") if form is None else F.replace(F.replace(F.lit(form), F.lit("{t}"), F.col("t").cast("string")), F.lit("{c}"), F.col("c").cast("string"))
        out = F.when(F.col("k") % len(forms) == i, v) if out is None else out.when(F.col("k") % len(forms) == i, v)
    return out


def _case_sql(*forms):
    lit = lambda f: "NULL" if f is None else "replace(replace('" + f.replace("'", "''") + "', '{t}', t::VARCHAR), '{c}', c::VARCHAR)"
    return "CASE k % " + str(len(forms)) + " " + " ".join(f"WHEN {i} THEN {lit(f)}" for i, f in enumerate(forms)) + " END"


_LINEAR = ("subtract({t}, 100), divide(#0, const_2)", "table_sum(quantity, none)", "table_max(Quantity, none), add(#0, {t})", "divide({t}, 0)", "greater({t}, {c})", "add(#0, 1)", "table_average(quantity, none), multiply(#0, 50%)", "exp(2, 3), add(#0, {c}")
_NESTED = ("divide(subtract({t}, 100), const_2)", "subtract({t}, 100), divide(#0, const_2)", "add(multiply({c}, 2), multiply({t}, 3))", "```\nmultiply({c}, 2)\n```")
_FAULTY = ("add({t}, 1), multiply(#0, 2)", "", "add({t} 1)", "power({t}, 1)", "add({t}, 1, 2)", "add(#1, {t})", "add({t}, 1), ", "add({t}, 1) and more")


def _table(spark, sf_dir):
    """Orders with a table of one labelled row of quantities."""
    q = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("qs"))  # seven lines at most
    t = _orders(spark, sf_dir).join(q, "o_orderkey")
    return t.withColumn("table", F.array(F.concat(F.array(F.lit("quantity")), F.transform("qs", lambda v: v.cast("string"))))).withColumn("program", _case(*_LINEAR))


_TABLE = _ORDERS + ", q AS (SELECT l_orderkey AS o_orderkey, list(l_quantity::BIGINT) AS qs FROM lineitem GROUP BY ALL), p AS (SELECT *, " + _case_sql(*_LINEAR) + " AS program FROM o JOIN q USING (o_orderkey))"


def j2(spark, sf_dir):
    return _table(spark, sf_dir).select("o_orderkey", F.array_join(P.lenient_tokens(F.col("program")), "|").alias("tokens"))


def j23(spark, sf_dir):
    """Tokens as numbers and back again."""
    own = F.array(F.col("t").cast("string"), F.col("c").cast("string"))
    p = _table(spark, sf_dir).withColumn("tokens", P.lenient_tokens(F.col("program"))).withColumn("i", P.token_indices(F.col("tokens"), own))
    back = P.tokens_of_indices(F.col("i"), own)
    known = F.forall(F.zip_with("tokens", back, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z: (z["a"] == z["b"]) | (z["b"] == "UNK"))
    return p.select("o_orderkey", F.get("i", F.lit(0)).alias("first"), F.size(F.filter("i", lambda x: x >= len(P.VOCABULARY))).cast("long").alias("own"), F.size(F.filter("i", lambda x: x == 1)).cast("long").alias("unknown"), known.alias("known"))


def j4(spark, sf_dir):
    p = _orders(spark, sf_dir).select("o_orderkey", P.parse_linear_coded(_case(*_FAULTY)).alias("p"))
    return p.select("o_orderkey", F.coalesce(F.size("p.steps"), F.lit(0)).cast("long").alias("steps"), F.col("p.error").alias("error"))


def j5(spark, sf_dir):
    s = P.best_effort_steps(_case("so we add( {t} ,{c}) and then divide(#0, 2)", "nothing here", "sum(1, 2), subtract({t}, 5)"))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(s, lambda x: F.concat_ws(" ", x["op"], x["a"], x["b"])), "; ").alias("steps"))


def j6(spark, sf_dir):
    a = P.flat_audit(F.when(F.col("k") == 5, "").otherwise(F.col("program")))
    return _table(spark, sf_dir).select("o_orderkey", a.alias("a")).select("o_orderkey", F.array_join("a.ops", ">").alias("ops"), F.array_join("a.operands", "|").alias("operands"), F.col("a.n_steps").cast("long").alias("n_steps"), "a.parse_ok", "a.kind")


def j12(spark, sf_dir):
    r = _table(spark, sf_dir).withColumn("r", P.official_run(F.col("program"), F.col("table")))
    return r.select("o_orderkey", "r.invalid", F.round("r.value", 5).alias("value"), "r.flag")


def j20(spark, sf_dir):
    """Programs on which the two executors or the gold value differ, by kind of difference."""
    p = _table(spark, sf_dir).withColumn("run", P.execute(P.parse_linear(F.col("program")), F.col("table"))).withColumn("own", P.answer(F.col("run"))).withColumn("official", P.official_run(F.col("program"), F.col("table")))
    gold = F.when(F.col("k") == 0, F.round((F.col("t") - 100) / 2, 5)).when(F.col("k") == 1, F.aggregate("qs", F.lit(0).cast("long"), lambda s, v: s + v).cast("double"))
    kind = F.when(~F.col("own").eqNullSafe(F.col("official.value")), "executors_differ").when(gold.isNotNull() & ~F.col("own").eqNullSafe(gold), "gold_differs")
    return p.where(kind.isNotNull()).groupBy(kind.alias("kind"), F.regexp_extract("program", "^[a-z_]+", 0).alias("first_op")).agg(F.count("*").alias("n"))


def j24(spark, sf_dir):
    """Dispatch: cleaned, read as linear or nested, executed."""
    ship(spark)
    o = _orders(spark, sf_dir).withColumn("program", P.clean_program(_case(*_NESTED))).withColumn("linear", P.is_linear(F.col("program")))
    o = o.withColumn("nested", P.parse_nested(F.when(~F.col("linear"), F.col("program")))).withColumn("steps", F.when(F.col("linear"), P.parse_linear_coded(F.col("program"))["steps"]).otherwise(F.col("nested.steps")))
    o = o.withColumn("run", P.execute(F.col("steps")))
    return o.select("o_orderkey", "linear", P.answer(F.col("run")).alias("value"))


def j19(spark, sf_dir):
    """One call for a response: program found, parsed, executed and compared with the gold value."""
    reply = _case("PROGRAM: subtract({t}, 100), divide(#0, 2)\nANSWER: 7", "I do not know", "PROGRAM: divide", "PROGRAM: add({t}, 1", "PROGRAM: divide({t}, 0)", "program: add({t}, 5)")
    o = _orders(spark, sf_dir).withColumn("program", P.clean_program(P.program_of_response(reply))).withColumn("steps", P.parse_linear(F.col("program"))).withColumn("run", P.execute(F.col("steps")))
    o = o.withColumn("value", P.answer(F.col("run")))
    status = P.failure(F.col("program"), F.col("steps"), F.col("run"), F.abs(F.col("value") - F.round((F.col("t") - 100) / 2, 5)) < 1e-9)
    o = o.withColumn("status", status)
    return o.groupBy("status", P.category(F.col("status")).alias("category"), P.operator_only(F.col("program")).alias("operator_only")).agg(F.count("*").alias("n"))


def j16(spark, sf_dir):
    """Programs that are the same function of their operands though their steps differ."""
    ship(spark)
    a = P.parse_nested(_case("multiply(add(x, {t}), y)", "subtract(divide({t}, y), divide(x, y))", "divide(subtract({t}, x), x)", "add({t}, x)"))
    b = P.parse_nested(_case("add(multiply(x, y), multiply({t}, y))", "divide(subtract({t}, x), y)", "subtract(divide({t}, x), const_1)", "add({t}, y)"))
    o = _orders(spark, sf_dir).withColumn("a", a).withColumn("b", b)
    return o.withColumn("same", P.same_algebra(F.col("a.steps"), F.col("b.steps"))).groupBy((F.col("k") % 4).alias("form")).agg(F.count("*").alias("n"), F.count_if("same").alias("same"))


_DERIVED = ("({t} + {c}) / 2", "{t} - {c}", "{t} * 3 / {c}", "average of {t} and {c}", "{t} × 2 ## {c}", "")


def h17(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("d", _case(*_DERIVED)).withColumn("kind", F.element_at(F.array(*map(F.lit, ("arithmetic", "span", "multi-span", "count", "arithmetic"))), (F.col("c") % 5 + 1).cast("int")))
    return o.select("o_orderkey", F.array_join(D.inferred_operators(F.col("d")), ",").alias("ops"), D.inferred_operator(F.col("kind"), F.col("d"), F.col("c") % 7 == 0).alias("operator"))


def h8(spark, sf_dir):
    w = X.plain_tokens(F.col("text"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", w.alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


_ANSWERS = (("{t}", ""), ("$1,234", "million"), ("{t} million", ""), ("{t} million", "millions"), ("{t} thousand", "million"), ("{t}%", "percent"), ("about {t}", ""), ("+{c}.5", "%"))


def h28(spark, sf_dir):
    a = X.canonical_answer(_case(*(a for a, _ in _ANSWERS)), _case(*(s for _, s in _ANSWERS)))
    return _orders(spark, sf_dir).select("o_orderkey", a.alias("a")).select("o_orderkey", "a.answer", "a.scale", F.array_join("a.changes", ",").alias("changes"))


def h37(spark, sf_dir):
    a = X.answer_of_json(_case('{"answer": "{t}"}', '```json\n{"answer": {c}}\n```', 'Sure: {"answer": "yes"} done', "no json", "[{t}]", '{"reply": 1}', '{"answer": {t', "17"))
    o = _orders(spark, sf_dir).withColumn("a", a)
    return o.select("o_orderkey", "a.answer", "a.error", X.allowed(F.col("a.answer"), ["yes", "no"]).alias("allowed"))


def h42(spark, sf_dir):
    p = X.prediction(_case('["{t}", "million"]', '{"answer": ["{t}", "{c}"], "scale": "percent"}', '{"prediction": {c}, "program": "add(1, {c})"}', "{t}"))
    return _orders(spark, sf_dir).select("o_orderkey", p.alias("p")).select("o_orderkey", F.array_join("p.answers", "|").alias("answers"), "p.scale", "p.program")


def h43(spark, sf_dir):
    t, c = F.col("t").cast("string"), F.col("c").cast("string")
    return _orders(spark, sf_dir).groupBy(X.same_items(F.array(t, c, F.lit("Net ")), F.array(F.lit("net"), F.when(F.col("k") % 2 == 0, c).otherwise(t), t)).alias("same")).agg(F.count("*").alias("n"))


def h25(spark, sf_dir):
    gold = F.concat((F.col("c") % 100).cast("string"), F.lit("."), (F.col("t") % 10).cast("string"), F.when(F.col("k") < 4, "%").otherwise(""))
    pred = F.when(F.col("k") % 2 == 0, F.concat(F.lit("0."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("("), (F.col("c") % 100).cast("string"), F.lit(")")))
    question = F.when(F.col("k") == 4, "What percentage changed?").otherwise("How much?")
    r = N.reconciled(question, gold, pred)
    return _orders(spark, sf_dir).select("o_orderkey", r.alias("r")).select("o_orderkey", F.round("r.pred", 9).alias("pred"), F.round("r.gold", 9).alias("gold"), "r.percent")


def b5(spark, sf_dir):
    """Facts of name and value pairs, and which values are one number and nothing else."""
    p = F.array(F.array(F.lit(" price "), F.concat(F.lit("$ "), F.format_number("t", 0))), F.array(F.lit("note"), F.lit(" ")), F.array(F.lit("share"), F.concat((F.col("c") % 50).cast("string"), F.lit(" of 7"))), F.array(F.lit("change"), F.concat(F.lit("("), F.col("c").cast("string"), F.lit("%)"))))
    o = _orders(spark, sf_dir).select("o_orderkey", F.explode(F.arrays_zip(A.pair_facts(p).alias("fact"), F.transform(F.filter(p, lambda x: F.trim(x[1]) != ""), lambda x: x[1]).alias("v"))).alias("f"))
    return o.select("o_orderkey", "f.fact", N.single_number(F.col("f.v")).alias("atomic"))


def b9(spark, sf_dir):
    """Safe features of orders: by pattern, by group, without null and NaN."""
    m = F.create_map(F.lit("q_price"), F.col("t").cast("double"), F.lit("gold_price"), F.col("t").cast("double"), F.lit("q_cust"), F.when(F.col("k") == 3, float("nan")).otherwise(F.col("c").cast("double")), F.lit("is_odd"), (F.col("t") % 2).cast("double"), F.lit("t_rows"), F.when(F.col("k") != 2, F.col("k").cast("double")))
    safe = A.safe_features(m, "(?i)gold|answer|correct")
    o = _orders(spark, sf_dir).select("o_orderkey", safe.alias("s"))
    return o.select("o_orderkey", F.array_join(F.array_sort(F.map_keys("s")), ",").alias("safe"), F.array_join(F.array_sort(F.map_keys(A.feature_group(F.col("s"), ["q_"], ["is_odd"]))), ",").alias("group"))


def b11(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(X.contains_any(F.col("text"), ["the", "of the", "et"])).alias("hits"))


def b14(spark, sf_dir):
    """Paragraphs that a question names by order, or all; and items that hold a keyword whatever the blanks."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("order"), F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_linenumber").cast("string")).alias("text"))).alias("p"))
    named = F.array(F.lit(2), F.lit(5))
    return li.select("l_orderkey", F.array_join(A.relevant(F.col("p"), named), ";").alias("relevant"), F.array_join(F.array_sort(A.keep_keyword(F.transform("p", lambda x: x["text"]), F.lit("r 3"))), ";").alias("keyword"))


def k1(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("b"))  # five types at most
    return e.select("user_id", F.round(A.bag_f1(F.col("a"), F.col("b")), 9).alias("f1"))


def _mixed(spark, sf_dir):
    o = _orders(spark, sf_dir)
    gp = F.when(F.col("k") < 4, F.concat(F.lit("add("), F.col("t").cast("string"), F.lit(", 0)")))
    pp = F.when(F.col("k").isin(0, 1, 4, 5), F.concat(F.lit("add("), (F.col("t") + F.when(F.col("k") == 1, F.col("t")).otherwise(0)).cast("string"), F.lit(", 0)")))
    o = o.withColumn("gp", gp).withColumn("pp", pp).withColumn("ga", F.when(F.col("k") == 7, "net sales").otherwise(F.col("t").cast("string"))).withColumn("pa", F.when(F.col("k") == 2, (F.col("t") + 0.05).cast("string")).when(F.col("k") == 3, "unknown").when(F.col("k") == 7, "sales").otherwise(F.col("t").cast("string")))
    run = lambda c: P.answer(P.execute(P.parse_linear(F.col(c))))
    o = o.withColumn("gv", run("gp")).withColumn("pv", run("pp"))
    return o.withColumn("m", E.mixed(F.col("ga"), F.col("gp"), F.col("gv"), F.col("pa"), F.col("pp"), F.col("pv")))


def k6(spark, sf_dir):
    ship(spark)
    g = E.grouped(_mixed(spark, sf_dir).select("m.*"), "mode", "invalid")
    return g.select("mode", "invalid", "n", F.round("sum_em", 6).alias("sum_em"), F.round("mean_f1", 6).alias("mean_f1"))


def k7(spark, sf_dir):
    """Golds that fail as their own prediction: those with an empty answer."""
    ship(spark)
    o = _orders(spark, sf_dir).select("o_orderkey", F.array(_case("{t}", "net sales", "", "{t}%", "{c} million")).alias("a"), _case("", "thousand", "", "percent", "million").alias("s"), _case("arithmetic", "span", "span", "arithmetic", "count").alias("kind"))
    return E.self_check(o, "a", "s", "kind").select("o_orderkey", F.element_at("a", 1).alias("answer"))


def k9(spark, sf_dir):
    w = O.wide(arms(spark, sf_dir).where("replicate = 1"), by=("sample_id",))
    out = S.paired_bootstrap(w, "sample_id", "case", "both", BOOT, SEED)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def k12(spark, sf_dir):
    w = O.wide(arms(spark, sf_dir), by=("sample_id", "replicate", "cust"))
    w = w.withColumn("outcome", F.when(F.col("case") & F.col("both"), "both").when(F.col("case"), "case_only").when(F.col("both"), "both_only").otherwise("neither"))
    g = S.class_means(w, "outcome", "cust", "sample_id")
    return g.select("outcome", "n", F.round("cust", 6).alias("cust"), F.round("sample_id", 6).alias("sample_id"))


QUERIES = {"b5_pair_facts": b5, "b9_safe_features": b9, "b11_contains_any": b11, "b14_relevant_paragraphs": b14, "h8_plain_tokens": h8, "h17_inferred_operators": h17, "h25_reconciled_scale": h25, "h28_canonical_answer": h28, "h37_answer_json": h37, "h42_prediction_entries": h42, "h43_same_items": h43, "j2_lenient_tokens": j2, "j23_token_indices": j23, "j4_linear_errors": j4, "j5_best_effort": j5, "j6_flat_audit": j6, "j12_official_executor": j12, "j16_same_algebra": j16, "j19_evaluate": j19, "j20_differential": j20, "j24_dispatch": j24, "k1_bag_f1": k1, "k6_mixed_modes": k6, "k7_gold_self_check": k7, "k9_paired_bootstrap": k9, "k12_class_means": k12}
_VALUE = "CASE k WHEN 0 THEN (t - 100) / 2 WHEN 1 THEN list_sum(qs) WHEN 4 THEN (t > c)::INT WHEN 6 THEN list_avg(qs) * 0.5 WHEN 7 THEN 8 END::DOUBLE"
_NUM = r"regexp_extract_all({}, '[-]?[0-9]+[.]?[0-9]*')"
#: Draws of a resample: hashes of key and resample, a line and a square modulo 2^31 - 1, and the steps of the distribution function in 65536ths.
_DRAW = "(('0x' || substr(md5('{seed}|' || {key}), 1, 7))::BIGINT * r.x + ('0x' || substr(md5('{seed}|' || {key}), 8, 7))::BIGINT) % 2147483647"
_REPS = "r AS (SELECT rep, ('0x' || substr(md5('{seed}|rep|' || rep), 1, 7))::BIGINT + 1 AS x FROM range({reps}) t(rep))"
_STEPS = "(y >= 24110)::INT + (y >= 48219)::INT + (y >= 60274)::INT + (y >= 64292)::INT + (y >= 65297)::INT + (y >= 65498)::INT + (y >= 65531)::INT"
ORACLES = {
    "j2_lenient_tokens": rf"WITH {_TABLE} SELECT o_orderkey, array_to_string(list_concat(flatten(list_transform(string_split(program, ', '), lambda x: regexp_extract_all(x, '[^()]*\(|\)|[^()]+'))), ['EOF']), '|') AS tokens FROM p",
    "j23_token_indices": rf"WITH {_TABLE}, x AS (SELECT *, flatten(list_transform(string_split(program, ', '), lambda x: regexp_extract_all(x, '[^()]*\(|\)|[^()]+'))) AS tk, {P.VOCABULARY!r} AS v FROM p) SELECT o_orderkey, list_position(v, tk[1]) - 1 AS first, len(list_filter(tk, lambda y: NOT list_contains(v, y) AND y IN (t::VARCHAR, c::VARCHAR))) AS own, len(list_filter(tk, lambda y: NOT list_contains(v, y) AND y NOT IN (t::VARCHAR, c::VARCHAR))) AS unknown, true AS known FROM x",
    "j4_linear_errors": f"WITH {_ORDERS} SELECT o_orderkey, (k = 0)::BIGINT * 2 AS steps, ([NULL, 'empty', 'arity', 'operator', 'arity', 'reference', 'part', 'form'])[k + 1] AS error FROM o",
    "j5_best_effort": f"WITH {_ORDERS} SELECT o_orderkey, CASE k % 3 WHEN 0 THEN 'add ' || t || ' ' || c || '; divide #0 2' WHEN 2 THEN 'subtract ' || t || ' 5' END AS steps FROM o",
    "j6_flat_audit": rf"WITH {_TABLE}, x AS (SELECT o_orderkey, CASE WHEN k = 5 THEN '' ELSE program END AS p FROM p) SELECT o_orderkey, array_to_string(regexp_extract_all(p, '([a-z_]+)\(', 1), '>') AS ops, array_to_string(list_transform(flatten(list_transform(string_split(p, '('), lambda y, i: CASE WHEN i = 1 THEN []::VARCHAR[] WHEN contains(y, ')') THEN string_split(string_split(y, ')')[1], ',') ELSE string_split(y, ',')[1:1] END)), lambda z: trim(z)), '|') AS operands, len(regexp_extract_all(p, '[a-z_]+\(')) AS n_steps, p <> '' AND length(replace(p, '(', '')) = length(replace(p, ')', '')) AS parse_ok, CASE WHEN p = '' THEN 'span' ELSE 'program' END AS kind FROM x",
    "j12_official_executor": f"WITH {_TABLE} SELECT o_orderkey, k IN (2, 3, 5) AS invalid, round({_VALUE}, 5) AS value, CASE WHEN k = 4 THEN CASE WHEN t > c THEN 'yes' ELSE 'no' END END AS flag FROM p",
    "j20_differential": f"WITH {_TABLE} SELECT 'executors_differ' AS kind, CASE k WHEN 2 THEN 'table_max' ELSE 'exp' END AS first_op, count(*) AS n FROM p WHERE k IN (2, 7) GROUP BY ALL",
    "j24_dispatch": f"WITH {_ORDERS} SELECT o_orderkey, k % 4 = 1 AS linear, round(CASE k % 4 WHEN 0 THEN (t - 100) / 2 WHEN 1 THEN (t - 100) / 2 WHEN 2 THEN c * 2 + t * 3 ELSE c * 2 END::DOUBLE, 5) AS value FROM o",
    "j19_evaluate": f"WITH {_ORDERS}, s AS (SELECT CASE k % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'no_program' WHEN 2 THEN 'operator_only' WHEN 3 THEN 'parse_fail' WHEN 4 THEN 'exec_fail' ELSE CASE WHEN t + 5 = (t - 100) / 2 THEN 'success' ELSE 'wrong_result' END END AS status FROM o) SELECT status, CASE status WHEN 'success' THEN '' WHEN 'no_program' THEN 'extraction' WHEN 'parse_fail' THEN 'parse' WHEN 'exec_fail' THEN 'execution' ELSE status END AS category, status = 'operator_only' AS operator_only, count(*) AS n FROM s GROUP BY ALL",
    "j16_same_algebra": f"WITH {_ORDERS} SELECT k % 4 AS form, count(*) AS n, count(*) FILTER (k % 4 <> 3) AS same FROM o GROUP BY ALL",
    "h17_inferred_operators": f"""WITH {_ORDERS}, d AS (SELECT o_orderkey, c, {_case_sql(*_DERIVED)} AS d FROM o), x AS (SELECT *, list_filter([CASE WHEN contains(d, '+') THEN 'add' END, CASE WHEN contains(d, '-') THEN 'subtract' END, CASE WHEN contains(d, '*') OR contains(d, '×') THEN 'multiply' END, CASE WHEN contains(d, '/') THEN 'divide' END, CASE WHEN contains(d, 'average') THEN 'average' END, CASE WHEN contains(d, '##') THEN 'count_or_multi_item' END], lambda v: v IS NOT NULL) AS ops FROM d)
SELECT o_orderkey, array_to_string(ops, ',') AS ops, CASE WHEN c % 7 = 0 THEN 'comparison' WHEN c % 5 = 1 THEN 'span' WHEN c % 5 = 2 THEN 'multi_span' WHEN c % 5 = 3 THEN 'count' ELSE coalesce(ops[-1], 'arithmetic') END AS operator FROM x""",
    "h8_plain_tokens": r"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM w""",
    "h28_canonical_answer": f"WITH {_ORDERS} SELECT o_orderkey, CASE k WHEN 1 THEN '1234' WHEN 5 THEN t || '%' WHEN 6 THEN 'about ' || t WHEN 7 THEN c || '.5' ELSE t::VARCHAR END AS answer, (['', 'million', 'million', 'million', 'million', 'percent', '', 'percent'])[k + 1] AS scale, (['', 'numeric_format', 'embedded_scale:million,numeric_format,scale_split', 'duplicate_scale_removed,embedded_scale:million,numeric_format', 'embedded_scale:thousand,numeric_format,scale_conflict:thousand->million', 'duplicate_scale_removed,embedded_scale:percent,numeric_format', '', 'numeric_format'])[k + 1] AS changes FROM o",
    "h37_answer_json": f"WITH {_ORDERS} SELECT o_orderkey, CASE k WHEN 0 THEN t::VARCHAR WHEN 1 THEN c::VARCHAR WHEN 2 THEN 'yes' END AS answer, CASE k WHEN 3 THEN 'no_json' WHEN 4 THEN 'json_not_object' WHEN 5 THEN 'no_answer' WHEN 6 THEN 'parse_error' WHEN 7 THEN 'json_not_object' END AS error, k = 2 AS allowed FROM o",
    "h42_prediction_entries": f"WITH {_ORDERS} SELECT o_orderkey, CASE k % 4 WHEN 1 THEN t || '|' || c WHEN 2 THEN c::VARCHAR ELSE t::VARCHAR END AS answers, CASE k % 4 WHEN 0 THEN 'million' WHEN 1 THEN 'percent' ELSE '' END AS scale, CASE k % 4 WHEN 2 THEN 'add(1, ' || c || ')' END AS program FROM o",
    "h43_same_items": f"WITH {_ORDERS} SELECT k % 2 = 0 OR t = c AS same, count(*) AS n FROM o GROUP BY ALL",
    "h25_reconciled_scale": f"WITH {_ORDERS}, x AS (SELECT o_orderkey, k, (c % 100) + (t % 10) / 10.0::DOUBLE AS gold, CASE WHEN k % 2 = 0 THEN (c % 100) / 100.0::DOUBLE ELSE 0 - (c % 100)::DOUBLE END AS pred, k <= 4 AS percent FROM o) SELECT o_orderkey, round(CASE WHEN percent AND abs(pred) <= 1.5 THEN pred * 100 ELSE pred END, 9) AS pred, round(gold, 9) AS gold, percent FROM x",
    "b5_pair_facts": rf"""WITH {_ORDERS}, x AS (SELECT o_orderkey, unnest([('price', '$ ' || trim(format('{{:,}}', t))), ('share', (c % 50) || ' of 7'), ('change', '(' || c || '%)')]) AS f FROM o) SELECT o_orderkey, f[1] || ': ' || f[2] AS fact, regexp_full_match(regexp_replace(f[2], '[$%,()\s]', '', 'g'), '[-+]?[0-9]+') AS atomic FROM x""",
    "b9_safe_features": f"WITH {_ORDERS} SELECT o_orderkey, concat_ws(',', 'is_odd', CASE WHEN k <> 3 THEN 'q_cust' END, 'q_price', CASE WHEN k <> 2 THEN 't_rows' END) AS safe, concat_ws(',', 'is_odd', CASE WHEN k <> 3 THEN 'q_cust' END, 'q_price') AS \"group\" FROM o",
    "b11_contains_any": "SELECT lang, count(*) AS n, count(*) FILTER (contains(' ' || lower(text) || ' ', ' the ') OR contains(' ' || lower(text) || ' ', ' of the ') OR contains(' ' || lower(text) || ' ', ' et ')) AS hits FROM documents GROUP BY ALL",
    "b14_relevant_paragraphs": "WITH p AS (SELECT l_orderkey, coalesce(string_agg(l_returnflag || ' ' || l_linenumber, ';' ORDER BY l_linenumber, l_returnflag) FILTER (l_linenumber IN (2, 5)), string_agg(l_returnflag || ' ' || l_linenumber, ';' ORDER BY l_linenumber, l_returnflag)) AS relevant, coalesce(string_agg(l_returnflag || ' ' || l_linenumber, ';' ORDER BY l_returnflag || ' ' || l_linenumber) FILTER (contains(lower(l_returnflag) || l_linenumber, 'r3')), string_agg(l_returnflag || ' ' || l_linenumber, ';' ORDER BY l_returnflag || ' ' || l_linenumber)) AS keyword FROM lineitem GROUP BY l_orderkey) SELECT * FROM p",
    "k1_bag_f1": "WITH e AS (SELECT user_id, count(DISTINCT event_type) AS a, count(DISTINCT event_type) FILTER (value > 50) AS b FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * (b / a::DOUBLE) / (b / a::DOUBLE + 1.0) END, 9) AS f1 FROM e",
    "k6_mixed_modes": f"WITH {_ORDERS}, m AS (SELECT CASE WHEN k < 2 THEN 'program_vs_program' WHEN k < 4 THEN 'answer_vs_program' WHEN k < 6 THEN 'program_vs_span' ELSE 'span_vs_span' END AS mode, CASE k WHEN 1 THEN (t = 0)::INT WHEN 3 THEN 0 WHEN 7 THEN 0 WHEN 2 THEN (0.05 <= least(t / 1000.0, 0.1))::INT ELSE 1 END AS em, CASE k WHEN 1 THEN (t = 0)::INT WHEN 3 THEN 0 WHEN 7 THEN 0.67 WHEN 2 THEN (0.05 <= least(t / 1000.0, 0.1))::INT ELSE 1 END AS f1 FROM o) SELECT mode, false AS invalid, count(*) AS n, round(sum(em)::DOUBLE, 6) AS sum_em, round(avg(f1)::DOUBLE, 6) AS mean_f1 FROM m GROUP BY ALL",
    "k7_gold_self_check": f"WITH {_ORDERS} SELECT o_orderkey, '' AS answer FROM o WHERE k % 5 = 2",
    "k9_paired_bootstrap": f"WITH {ARMS_SQL}, {_REPS.format(seed=SEED, reps=BOOT)}, d AS (SELECT sample_id, case_::INT - both_::INT AS d FROM wide WHERE replicate = 1), z AS (SELECT rep, d, {_DRAW.format(seed=SEED, key='sample_id')} AS z FROM d, r), w AS (SELECT rep, d, z * z % 2147483647 // 32768 AS y FROM z), m AS (SELECT rep, sum(d * ({_STEPS})) / sum({_STEPS})::DOUBLE AS m FROM w GROUP BY rep) SELECT round((SELECT avg(d) FROM d), 9) AS diff, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m",
    "k12_class_means": f"WITH {ARMS_SQL}, c AS (SELECT w.*, o_custkey AS cust FROM wide w JOIN orders ON o_orderkey = sample_id) SELECT CASE WHEN case_ AND both_ THEN 'both' WHEN case_ THEN 'case_only' WHEN both_ THEN 'both_only' ELSE 'neither' END AS outcome, count(*) AS n, round(avg(cust), 6) AS cust, round(avg(sample_id), 6) AS sample_id FROM c GROUP BY ALL",
}
CLUSTER_BOOTSTRAP_SQL = f"WITH {ARMS_SQL}, {_REPS.format(seed=SEED, reps=BOOT)}, g AS (SELECT cust, sum(correct::INT) AS s, count(*) AS c FROM arms WHERE arm = 'case' GROUP BY cust), z AS (SELECT rep, s, c, {_DRAW.format(seed=SEED, key='cust')} AS z FROM g, r), w AS (SELECT rep, s, c, z * z % 2147483647 // 32768 AS y FROM z), m AS (SELECT rep, sum(s * ({_STEPS})) / sum(c * ({_STEPS}))::DOUBLE AS m FROM w GROUP BY rep) SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, round(avg(m), 9) AS mean FROM m"
