"""Queries of audits, joins, samples, validators, rendering, runs and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import programs as P
from ..operators import abstractions as B
from ..operators import integrity as M
from ..operators import outcomes as O
from ..operators import policies as L
from ..operators import rendering as R
from ..operators import retrieval as V
from ..operators import runs
from ..operators import tables as T
from ..shipping import ship
from .evaluation import _ORDERS, _TABLE, _case, _orders, _table
from .outcomes import _q, arms
from .outcomes import _sql as arms_sql


def _results(spark, sf_dir):
    """(o_orderkey, arm, status, correct): a program's fate in two arms."""
    t = _table(spark, sf_dir).withColumn("steps", P.parse_linear(F.col("program"))).withColumn("run", P.execute(F.col("steps"), F.col("table")))
    t = t.withColumn("ok", P.answer(F.col("run")) > 10)
    shown = F.when(F.col("k") == 1, None).otherwise(F.col("program"))
    return t.select("o_orderkey", F.when(F.col("c") % 2 == 0, "case").otherwise("none").alias("arm"), P.failure(shown, F.col("steps"), F.col("run"), F.col("ok")).alias("status"), F.coalesce(F.col("ok") & (F.col("k") != 1), F.lit(False)).alias("correct"))


def d11(spark, sf_dir):
    return O.funnel(_results(spark, sf_dir), "arm")


def d12(spark, sf_dir):
    return O.failures(_results(spark, sf_dir), "status", "arm")


def d15(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").cast("double").alias("v"), F.col("l_linenumber").cast("long").alias("n"))
    return O.running_mean(li, "v", "n", "l_returnflag").select("l_returnflag", "n", F.round("mean", 9).alias("mean"))


def d16(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("v", (F.col("l_quantity") > 25).cast("double"))
    return O.tallies(li, "v", "l_returnflag", "l_linestatus").select("kind", "key", "n", F.round("mean", 9).alias("mean"))


def d35(spark, sf_dir):
    t = _table(spark, sf_dir).withColumn("steps", P.parse_linear(F.col("program"))).where("steps is not null").withColumn("run", P.execute(F.col("steps"), F.col("table"))).withColumn("failed", ~F.col("run.ok"))
    return O.family_audit(t, "steps", "o_orderkey", "failed", {"table": F.col("s.op").startswith("table_"), "reference": F.col("s.a").startswith("#"), "constant": F.col("s.b").startswith("const_"), "divide": F.col("s.op") == "divide"})


def d42(spark, sf_dir):
    d = O.drill_down(arms(spark, sf_dir).where("replicate = 2"))
    return d.select("arm", "kind", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def c9(spark, sf_dir):
    """Mean diagnostic of the cases that each target retrieved."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hits = li.select(F.col("l_orderkey").alias("target_id"), (F.col("l_linenumber") * 7 + F.col("l_orderkey") % 3).cast("long").alias("source_id")).distinct()
    diag = li.groupBy(F.col("l_orderkey").alias("target_id"), (F.col("l_linenumber") * 7).cast("long").alias("source_id")).agg(F.max("l_quantity").cast("double").alias("score"))
    return T.averaged_pairs(hits, diag, "score").select("target_id", "matches", F.round("mean", 6).alias("mean"))


def c12(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "c")
    audit = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber < 4").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") > 45).alias("contaminated"))
    return T.marked(o, audit, "o_orderkey", "contaminated").where("not contaminated").select("o_orderkey")


def f10(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return T.budget_plan(o, "o_orderkey", {"dear": (F.col("t") > 200_000, 5), "odd": (F.col("c") % 2 == 1, 7), "any": (F.lit(True), 4)}, "plan")


def f12(spark, sf_dir):
    a = arms(spark, sf_dir).groupBy("arm").agg(F.round(F.avg(O.hit()), 2).alias("eligible"), F.avg((F.col("tokens") % 3 == 0).cast("double")).alias("overall"))
    return T.best_by(a, "arm", "eligible", "overall").select("arm")


def f14(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", ((F.col("t") % 10) / 10.0).alias("before"), ((F.col("c") % 10) / 10.0).alias("after"))
    return T.coverage_groups(o, "o_orderkey", "before", "after", 12, "cover")


def _cases(spark, sf_dir):
    """Cases as they should be, tampered with by k of the customer: field, step, value, grounding, answer."""
    t = _table(spark, sf_dir).where("k in (0, 1, 4, 6)").withColumn("steps", P.parse_linear(F.col("program"))).withColumn("grounding", M.grounding(F.col("steps"), F.col("table")))
    t = t.withColumn("run", P.execute(F.col("steps"), F.col("table")))
    a = F.col("c") % 6
    step = F.transform("steps", lambda s, i: F.struct(F.when((a == 1) & (i == 0), "exp").otherwise(s["op"]).alias("op"), s["a"].alias("a"), s["b"].alias("b")))
    vals = F.transform("run.vals", lambda v, i: F.when((a == 2) & (i == 0), v + 1).otherwise(v))
    ground = F.when((a == 3) & (F.size("grounding") > 0), F.transform_values("grounding", lambda k, v: F.concat(v, F.array(F.lit(9e9))))).otherwise(F.col("grounding"))
    return t.select("o_orderkey", "k", "c", "table", F.when(a == 4, None).otherwise(F.col("program")).alias("program"), step.alias("steps"), vals.alias("vals"), ground.alias("grounding"), (F.element_at("run.vals", -1) + F.when(a == 5, 0.5).otherwise(0.0)).alias("answer"))


def m3(spark, sf_dir):
    v = M.case_violations(_cases(spark, sf_dir), "o_orderkey")
    return v.groupBy("check").agg(F.count("*").alias("n"))


def m5(spark, sf_dir):
    ops = F.when(F.col("k") % 2 == 0, F.array(F.lit("divide"), F.lit("subtract"))).otherwise(F.array(F.lit("add")))
    text = _case("Divide the step by the other value", "Find relevant values, look at the table, use the information", "The ratio of both, then compare", "short")
    o = _orders(spark, sf_dir).select("k", F.array_join(B.preserved(ops, text), ",").alias("preserved"), F.array_join(B.thin(text, 40), ",").alias("thin"), B.overlong(ops, F.repeat(text, 60)).alias("overlong"))
    return o.groupBy((F.col("k") % 4).alias("form"), "preserved", "thin", "overlong").agg(F.count("*").alias("n"))


def m9(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("text", F.concat_ws(" ", F.lit("what was order"), F.when(F.col("k") < 2, F.col("t").cast("string")), F.when(F.col("k") % 3 == 0, "of BUILDING"), F.lit("worth")))
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"), "c_mktsegment")
    return M.label_leaks(o.join(cu, "c"), "o_orderkey", "text", {"answer": F.col("t").cast("string"), "segment": F.col("c_mktsegment")})


def m10(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("lines"), F.col("l_quantity").cast("long").alias("quantity"))
    stated = li.groupBy("o_orderkey").agg((F.count("*") + (F.col("o_orderkey") % 50 == 3).cast("int")).alias("lines"), F.sum("quantity").alias("quantity")).where("o_orderkey % 97 <> 5")
    return M.total_faults(li, stated, "o_orderkey", "lines", "quantity")


def m11(spark, sf_dir):
    o = _orders(spark, sf_dir)
    text = F.when(F.col("k") == 0, F.concat(F.lit("Divide by "), F.col("t").cast("string"))).when(F.col("k") == 1, "Add  both amounts").otherwise(F.concat(F.lit("order of "), F.translate(F.col("o_orderkey").cast("string"), "0123456789", "abcdefghij")))
    fields = F.create_map(F.lit("name"), F.lit("n"), F.lit("steps"), F.when(F.col("k") == 2, " ").otherwise("s"))
    s = o.select("o_orderkey", fields.alias("fields"), text.alias("text"), F.col("c").alias("support"))
    return M.strategy_faults(s, "o_orderkey", "fields", ["name", "steps"], "text", "support", 1000, 0.01).groupBy("check").agg(F.count("*").alias("n"))


def m12(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("p"))
    return M.truncation(d, "doc_id", "p", 600).select("doc_id", "chars", "kept", F.round("lost_share", 9).alias("lost_share"))


def n3(spark, sf_dir):
    t = _table(spark, sf_dir)
    ops = P.operations(F.col("program"))
    return t.select("o_orderkey", R.case_record(id=F.col("o_orderkey"), program=F.col("program"), structure=F.array_join(ops, ">"), question=F.when(F.col("k") != 3, F.concat(F.lit("price of "), F.col("c").cast("string")))).alias("record"), R.strategy_text(ops).alias("strategy"))


def n7(spark, sf_dir):
    q = F.concat(F.lit("What is the total change in 2019 and the ratio of "), F.col("c").cast("string"), F.lit(" percent?"))
    f = _table(spark, sf_dir).select("o_orderkey", R.numeric_features(q, F.col("table"), F.col("program")).alias("f"))
    return f.select("o_orderkey", F.size("f").cast("long").alias("size"), *(F.col("f")[c].alias(c) for c in ("q_chars", "q_numbers", "q_change", "t_cells", "p_steps", "p_table", "p_references")))


def h20(spark, sf_dir):
    ship(spark)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", F.col("l_quantity").cast("long").alias("q")))).alias("r"))  # seven lines at most
    html = F.concat(F.lit("<p>x</p><table><tr><th>line</th><th>a &amp; b</th></tr>"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("<tr><td>"), x["l_linenumber"].cast("string"), F.lit("</td><td><b>"), x["l_returnflag"], F.lit("</b> "), x["q"].cast("string"), F.lit("</td></tr>"))), ""), F.lit("<tr><td>end</tr></table>"))
    return li.select("l_orderkey", R.html_markdown(html).alias("markdown"))


def _service(prompt: str, attempt: int) -> str:
    """A stand-in for a model: fails at first for some prompts, always for others, and answers with the prompt's number."""
    n = int(prompt.rsplit(" ", 1)[1])
    if n % 7 == 3 or (n % 5 == 1 and attempt == 0):
        raise RuntimeError("busy")
    if n % 11 == 4 and attempt < 2:
        return "not json"
    return '{"answer": "%d"}' % (n % 4)


def o3(spark, sf_dir):
    """Pending prompts called side by side with retries; failures are rows."""
    done = _orders(spark, sf_dir).where("k = 0").select("o_orderkey")
    o = runs.resumed(_orders(spark, sf_dir).withColumn("prompt", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))), done, "o_orderkey")
    r = runs.called(o, "o_orderkey", "prompt", _service, 2)
    return r.groupBy("attempts", "error").agg(F.count("*").alias("n"), F.count("response").alias("answered"))


def o5(spark, sf_dir):
    """Replies that do not parse are asked for again; what never parses is a dead letter."""
    o = _orders(spark, sf_dir).withColumn("prompt", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    r = runs.parsed(o, "o_orderkey", "prompt", _service, rounds=3)
    return r.groupBy("round", "error", "answer").agg(F.count("*").alias("n"))


def o6(spark, sf_dir):
    """Every arm run over every target: prompts built, called, read and compared."""
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("target_id"), (F.col("o_orderkey") % 3).alias("gold"))
    p = lambda s: F.concat(F.lit(s), F.col("target_id").cast("string"))
    return runs.run_arms(o, {"none": p("question "), "case": p("case and question ")}, _service, "gold").groupBy("arm", "error", "correct").agg(F.count("*").alias("n"))


def _writer(prompt: str, attempt: int) -> str:
    """A stand-in for a generator of strategies that mends the faults it is told of, but for some."""
    n = int(prompt.split("\n")[0].rsplit(" ", 1)[1])
    return "Then divide" if n % 3 == 0 or ("Avoid" in prompt and n % 3 == 1) else f"Divide by {n}"


def o7(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("prompt", F.concat(F.lit("write "), F.col("o_orderkey").cast("string")))
    faults = lambda x: F.array_compact(F.array(F.when(x.rlike("[0-9]"), "number")))
    r = runs.regenerated(o, "o_orderkey", "prompt", _writer, faults, 3)
    return r.groupBy("round", F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n"))


def _encoded(spark, sf_dir, whole=False):
    return V.hashed_vectors(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 16, whole)


def a15(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", F.posexplode("vector").alias("slot", "v")).where("v <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("v", 9).alias("v"))


def i11(spark, sf_dir):
    """Stored vectors against the encoder: some changed, some scaled, some lost."""
    e = _encoded(spark, sf_dir, whole=True)
    k = F.col("doc_id") % 40
    stored = e.where(k != 3).select("doc_id", F.transform("vector", lambda x: F.when(k == 5, x * 2).when(k == 7, -x).otherwise(x)).alias("vector"))
    return V.encoding_faults(stored, e, "doc_id")


def i2(spark, sf_dir):
    """Texts encoded and searched: the three nearest documents of each hundredth one."""
    e = _encoded(spark, sf_dir).where("exists(vector, x -> x <> 0)").withColumn("grp", F.lit(0))
    found = V.top_k(e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("target_id"), "vector", "grp"), e.select(F.col("doc_id").alias("source_id"), "vector", "grp"), 3, 5)
    return found.select("target_id", "rank", F.round("score", 5).alias("score"))


def i9(spark, sf_dir):
    """Family hits of two rankings of strategies."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").cast("long").alias("rank"), F.col("l_returnflag").alias("family")).distinct()
    wanted = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("target_id"), F.when(F.col("k") < 4, "R").otherwise("N").alias("family"))
    better = li.withColumn("rank", F.when(F.col("family") == "R", F.greatest(F.col("rank") - 1, F.lit(1))).otherwise(F.col("rank")))
    h = V.family_hits(li, better, wanted)
    return h.select(F.col("k").cast("long").alias("k"), F.round("baseline", 9).alias("baseline"), F.round("anchored", 9).alias("anchored"))


def _chances(spark, sf_dir):
    """Outcomes of one replicate with made-up chances of a gain and a harm for each arm."""
    w = O.wide(arms(spark, sf_dir).where("replicate = 0"), ("case", "strategy", "both"), ("sample_id",))
    p = lambda m, s: ((F.col("sample_id") * m + s) % 97 / 97.0)
    return w.select("*", p(13, 5).alias("gain_case"), p(29, 1).alias("gain_strategy"), p(41, 7).alias("harm_case"), p(53, 2).alias("harm_strategy"))


_ARMS = ("case", "strategy")


def l6(spark, sf_dir):
    """The gain and harm grid, rated in one pass."""
    pick = lambda g: L.by_gain_and_harm({a: F.col(f"gain_{a}") for a in _ARMS}, {a: F.col(f"harm_{a}") for a in _ARMS}, g["lam"], g["t"], "both", _ARMS)
    t = L.grid_table(_chances(spark, sf_dir), [{"lam": x, "t": y} for x in (1.0, 2.0) for y in (0.0, 0.2, 0.5)], pick, ("both", *_ARMS), "both")
    return t.select("lam", "t", *(F.round(c, 9).alias(c) for c in ("mean", "se", "coverage")))


def l5(spark, sf_dir):
    pick = lambda g: L.by_delta({a: F.col(f"gain_{a}") - 0.4 for a in _ARMS}, g["t"], "both", _ARMS)
    t = L.grid_table(_chances(spark, sf_dir), [{"t": y} for y in L.THRESHOLDS], pick, ("both", *_ARMS), "both")
    return t.select("t", *(F.round(c, 9).alias(c) for c in ("mean", "coverage")))


def l7(spark, sf_dir):
    c = _chances(spark, sf_dir)
    x = c.withColumn("t", F.explode(F.array(*map(F.lit, L.GATES)))).withColumn("chosen", L.by_gate(F.col("gain_case"), {a: F.col(f"harm_{a}") for a in _ARMS}, F.col("t"), "both", _ARMS))
    return x.groupBy("t", "chosen").agg(F.count("*").alias("n"), F.round(F.avg(L.value_of(F.col("chosen"), ("both", *_ARMS))), 9).alias("value"))


def l9(spark, sf_dir):
    c = _chances(spark, sf_dir).withColumn("best", L.best_arm({a: O.hit(a) for a in ("both", *_ARMS)}, ("both", *_ARMS))).withColumn("chosen", L.best_arm({a: F.col(f"gain_{a}") for a in _ARMS}, _ARMS))
    m = L.selector_metrics(c, "chosen", "best", "case")
    return m.select(*(F.round(x, 9).alias(x) for x in m.columns))


QUERIES = {"a15_hashed_vectors": a15, "c9_averaged_pairs": c9, "c12_marked": c12, "d9_exclusive_ids": _q(O.exclusive_ids), "d11_funnel": d11, "d12_failures": d12, "d15_running_mean": d15, "d16_tallies": d16, "d35_family_audit": d35, "d41_family_gains": _q(lambda a: O.family_gains(a, "grp")), "d42_drill_down": d42, "f10_budget_plan": f10, "f12_best_method": f12, "f14_coverage_groups": f14, "h20_html_markdown": h20, "i2_text_search": i2, "i9_family_hits": i9, "i11_encoding_faults": i11, "l5_delta_thresholds": l5, "l6_gain_harm_grid": l6, "l7_gate": l7, "l9_selector_metrics": l9, "m3_case_violations": m3, "m5_preserved": m5, "m9_label_leaks": m9, "m10_total_faults": m10, "m11_strategy_faults": m11, "m12_truncation": m12, "n3_case_records": n3, "n7_numeric_features": n7, "o3_called": o3, "o5_parsed": o5, "o6_arms": o6, "o7_regenerated": o7}
_STATUS = "s AS (SELECT o_orderkey, CASE WHEN c % 2 = 0 THEN 'case' ELSE 'none' END AS arm, CASE k WHEN 1 THEN 'no_program' WHEN 3 THEN 'exec_fail' WHEN 5 THEN 'parse_fail' WHEN 7 THEN 'parse_fail' ELSE CASE WHEN CASE k WHEN 0 THEN (t - 100) / 2 WHEN 2 THEN list_max(qs) + t WHEN 4 THEN (t > c)::INT ELSE list_avg(qs) * 0.5 END > 10 THEN 'success' ELSE 'wrong_result' END END AS status FROM p)"
_HASH = "sha256('{tag}|' || o_orderkey)"
_CH = ", ch AS (SELECT sample_id, case_, strategy_, both_, (sample_id * 13 + 5) % 97 / 97.0::DOUBLE AS gc, (sample_id * 29 + 1) % 97 / 97.0::DOUBLE AS gs, (sample_id * 41 + 7) % 97 / 97.0::DOUBLE AS hc, (sample_id * 53 + 2) % 97 / 97.0::DOUBLE AS hs FROM wide WHERE replicate = 0)"
_V = "CASE chosen WHEN 'both' THEN both_ WHEN 'case' THEN case_ ELSE strategy_ END::INT"
ORACLES = {
    "a15_hashed_vectors": "WITH w AS (SELECT doc_id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))), 1, 8))::BIGINT AS h FROM documents), s AS (SELECT doc_id, h % 16 AS slot, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL) SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS v FROM s WHERE v <> 0",
    "c9_averaged_pairs": "WITH h AS (SELECT DISTINCT l_orderkey AS target_id, l_linenumber * 7 + l_orderkey % 3 AS source_id FROM lineitem), d AS (SELECT l_orderkey AS target_id, l_linenumber * 7 AS source_id, max(l_quantity)::DOUBLE AS score FROM lineitem GROUP BY ALL) SELECT target_id, count(score) AS matches, round(avg(score), 6) AS mean FROM h LEFT JOIN d USING (target_id, source_id) GROUP BY ALL",
    "c12_marked": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 4 AND l_quantity > 45)",
    "d9_exclusive_ids": arms_sql("SELECT CASE WHEN none_ THEN 'none' WHEN case_ THEN 'case' WHEN strategy_ THEN 'strategy' ELSE 'both' END AS arm, replicate::BIGINT AS replicate, sample_id FROM wide WHERE none_::INT + case_::INT + strategy_::INT + both_::INT = 1"),
    "d11_funnel": f"WITH {_TABLE}, {_STATUS} SELECT arm, count(*) AS n, count(*) FILTER (status <> 'no_program') AS has_program, count(*) FILTER (status NOT IN ('no_program', 'parse_fail')) AS parsed, count(*) FILTER (status IN ('success', 'wrong_result')) AS executed, count(*) FILTER (status = 'success') AS correct FROM s GROUP BY ALL",
    "d12_failures": f"WITH {_TABLE}, {_STATUS} SELECT arm, status, count(*) AS n FROM s WHERE status <> 'success' GROUP BY ALL",
    "d15_running_mean": "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS n, round(sum(l_quantity::DOUBLE * l_linenumber) / sum(l_linenumber), 9) AS mean FROM lineitem GROUP BY ALL",
    "d16_tallies": "WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b, (l_quantity > 25)::INT AS v FROM lineitem) SELECT 'all' AS kind, '' AS key, count(*) AS n, round(avg(v), 9) AS mean FROM x UNION ALL SELECT 'l_returnflag', a, count(*), round(avg(v), 9) FROM x GROUP BY a UNION ALL SELECT 'l_linestatus', b, count(*), round(avg(v), 9) FROM x GROUP BY b",
    "d35_family_audit": f"WITH {_TABLE} SELECT 'table' AS family, count(*) AS cases, count(*) AS steps, 0::BIGINT AS failures FROM p WHERE k IN (1, 2, 6) UNION ALL SELECT 'reference', count(*), count(*), 0 FROM p WHERE k IN (0, 2, 6) UNION ALL SELECT 'constant', count(*), count(*), 0 FROM p WHERE k = 0 UNION ALL SELECT 'divide', count(*), count(*), count(*) FILTER (k = 3) FROM p WHERE k IN (0, 3)",
    "d41_family_gains": arms_sql(", g AS (SELECT w.*, o_orderpriority AS grp FROM wide w JOIN orders ON o_orderkey = sample_id) SELECT grp, count(*) AS n, round(avg(case_::INT) - avg(none_::INT), 9) AS gain_case, round(avg(strategy_::INT) - avg(none_::INT), 9) AS gain_strategy, round(avg(both_::INT) - avg(none_::INT), 9) AS gain_both, count(*) FILTER (case_ AND NOT strategy_) AS case_only, count(*) FILTER (strategy_ AND NOT case_) AS strategy_only, count(*) FILTER (NOT case_ AND NOT strategy_) AS both_wrong FROM g GROUP BY ALL"),
    "d42_drill_down": arms_sql(", e AS (SELECT sample_id, unnest([('case', case_), ('strategy', strategy_), ('both', both_)]) AS x, none_ FROM wide WHERE replicate = 2), k AS (SELECT sample_id, x[1] AS arm, CASE WHEN x[2] AND NOT none_ THEN 'rescue' WHEN NOT x[2] AND none_ THEN 'harm' WHEN x[2] THEN 'both_right' ELSE 'both_wrong' END AS kind FROM e) SELECT arm, kind, count(*) AS n, array_to_string(list(sample_id ORDER BY sample_id)[1:3], ',') AS examples FROM k GROUP BY ALL"),
    "f10_budget_plan": f"WITH {_ORDERS}, a AS (SELECT o_orderkey FROM o WHERE t > 200000 ORDER BY {_HASH.format(tag='plan')}, o_orderkey LIMIT 5), b AS (SELECT o_orderkey FROM o WHERE c % 2 = 1 AND o_orderkey NOT IN (FROM a) ORDER BY {_HASH.format(tag='plan')}, o_orderkey LIMIT 7), d AS (SELECT o_orderkey FROM o WHERE o_orderkey NOT IN (FROM a) AND o_orderkey NOT IN (FROM b) ORDER BY {_HASH.format(tag='plan')}, o_orderkey LIMIT 4) SELECT o_orderkey, 'dear' AS slot FROM a UNION ALL SELECT o_orderkey, 'odd' FROM b UNION ALL SELECT o_orderkey, 'any' FROM d",
    "f12_best_method": arms_sql("SELECT arm FROM (SELECT arm, round(avg(correct::INT), 2) AS e, avg((tokens % 3 = 0)::INT) AS o FROM arms GROUP BY arm) ORDER BY e DESC, o DESC, arm LIMIT 1"),
    "f14_coverage_groups": f"WITH {_ORDERS}, g AS (SELECT o_orderkey, CASE WHEN t % 10 < 5 THEN 'A' ELSE 'B' END AS \"group\" FROM o WHERE c % 10 >= 5) SELECT o_orderkey, \"group\" FROM g QUALIFY row_number() OVER (PARTITION BY \"group\" ORDER BY {_HASH.format(tag='cover')}, o_orderkey) <= 12",
    "h20_html_markdown": "SELECT l_orderkey, '| line | a & b |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' ' || l_quantity::BIGINT || ' |', chr(10) ORDER BY l_linenumber, l_returnflag, l_quantity::BIGINT) || chr(10) || '| end |  |' AS markdown FROM lineitem GROUP BY l_orderkey",
    "i2_text_search": "WITH w AS (SELECT doc_id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))), 1, 8))::BIGINT AS h FROM documents), s AS (SELECT doc_id, h % 16 AS slot, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL HAVING v <> 0), n AS (SELECT doc_id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM s), d AS (SELECT doc_id, list(v ORDER BY slot) AS x FROM (SELECT i.doc_id, g.slot, coalesce(n.v, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT doc_id FROM n) i CROSS JOIN (SELECT range AS slot FROM range(16)) g LEFT JOIN n ON n.doc_id = i.doc_id AND n.slot = g.slot) GROUP BY doc_id), c AS (SELECT a.doc_id AS target_id, b.doc_id AS source_id, round(list_cosine_similarity(a.x, b.x), 5) AS score FROM d a JOIN d b ON a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0) SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id) AS rank, score FROM c QUALIFY rank <= 3",
    "i9_family_hits": "WITH w AS (SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 8 < 4 THEN 'R' ELSE 'N' END AS f FROM orders), h AS (SELECT w.target_id, min(l_linenumber) AS p, min(CASE WHEN f = 'R' AND l_linenumber > 1 THEN l_linenumber - 1 ELSE l_linenumber END) AS a FROM w LEFT JOIN lineitem ON l_orderkey = target_id AND l_linenumber <= 4 AND l_returnflag = f GROUP BY ALL) SELECT k, round(avg(coalesce(p <= k, false)::INT), 9) AS baseline, round(avg(coalesce(a <= k, false)::INT), 9) AS anchored FROM h, (VALUES (1::BIGINT), (2), (3)) k(k) GROUP BY k",
    "i11_encoding_faults": "WITH z AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 AS has FROM documents) SELECT 'missing' AS \"check\", doc_id FROM z WHERE doc_id % 40 = 3 UNION ALL SELECT 'other_values', doc_id FROM z WHERE has AND doc_id % 40 IN (5, 7) UNION ALL SELECT 'not_unit', doc_id FROM z WHERE doc_id % 40 <> 3 AND (NOT has OR doc_id % 40 = 5)",
    "l5_delta_thresholds": arms_sql(_CH + f", g AS (SELECT *, CASE WHEN greatest(gc - 0.4, gs - 0.4) > t THEN CASE WHEN gc - 0.4 = greatest(gc - 0.4, gs - 0.4) THEN 'case' ELSE 'strategy' END ELSE 'both' END AS chosen FROM ch, (VALUES {', '.join(f'({x}::DOUBLE)' for x in L.THRESHOLDS)}) x(t)) SELECT t, round(avg({_V}), 9) AS mean, round(avg((chosen <> 'both')::INT), 9) AS coverage FROM g GROUP BY t"),
    "l6_gain_harm_grid": arms_sql(_CH + f", s AS (SELECT *, gc - lam * hc AS a, gs - lam * hs AS b FROM ch, (VALUES (1.0::DOUBLE), (2.0)) x(lam), (VALUES (0.0::DOUBLE), (0.2), (0.5)) y(t)), g AS (SELECT *, CASE WHEN greatest(a, b) > t THEN CASE WHEN a = greatest(a, b) THEN 'case' ELSE 'strategy' END ELSE 'both' END AS chosen FROM s) SELECT lam, t, round(avg({_V}), 9) AS mean, round(stddev_samp({_V}) / sqrt(count(*)), 9) AS se, round(avg((chosen <> 'both')::INT), 9) AS coverage FROM g GROUP BY ALL"),
    "l7_gate": arms_sql(_CH + f", g AS (SELECT *, CASE WHEN gc <= t THEN 'both' WHEN hc >= hs THEN CASE WHEN gc <= least(0.95::DOUBLE, t + 0.15) THEN 'both' ELSE 'case' END ELSE 'strategy' END AS chosen FROM ch, (VALUES {', '.join(f'({x}::DOUBLE)' for x in L.GATES)}) x(t)) SELECT t, chosen, count(*) AS n, round(avg({_V}), 9) AS value FROM g GROUP BY ALL"),
    "l9_selector_metrics": arms_sql(_CH + ", p AS (SELECT CASE WHEN both_ OR NOT (case_ OR strategy_) THEN 'both' WHEN case_ THEN 'case' ELSE 'strategy' END AS best, CASE WHEN gc >= gs THEN 'case' ELSE 'strategy' END AS chosen FROM ch), c AS (SELECT k, count(*) FILTER (best = k) AS n, count(*) FILTER (chosen = k) AS m, count(*) FILTER (best = k AND chosen = k) AS h FROM p, (VALUES ('both'), ('case'), ('strategy')) v(k) GROUP BY k), f AS (SELECT avg(CASE WHEN n + m = 0 THEN 0 ELSE 2.0::DOUBLE * h / (n + m) END) AS f FROM c) SELECT round((SELECT f FROM f), 9) AS macro_f1, round(avg((best = chosen)::INT), 9) AS accuracy, round(avg((chosen <> 'case')::INT) FILTER (best <> 'case'), 9) AS avoidance FROM p"),
    "m3_case_violations": f"WITH {_TABLE}, x AS (SELECT k, c % 6 AS a FROM p WHERE k IN (0, 1, 4, 6)) SELECT 'contract' AS \"check\", count(*) AS n FROM x WHERE a = 4 HAVING count(*) > 0 UNION ALL SELECT 'fidelity', count(*) FROM x WHERE a IN (1, 4) HAVING count(*) > 0 UNION ALL SELECT 'grounding', count(*) FROM x WHERE a = 1 OR a = 2 OR (a = 3 AND k IN (1, 6)) HAVING count(*) > 0 UNION ALL SELECT 'official', count(*) FROM x WHERE a IN (4, 5) HAVING count(*) > 0",
    "m5_preserved": f"WITH {_ORDERS}, x AS (SELECT k % 4 AS form FROM o) SELECT form, (['', 'no_operations_mentioned,operation_mismatch', 'no_operations_mentioned', 'no_operations_mentioned,operation_mismatch'])[form + 1] AS preserved, (['too_short', 'too_generic', 'too_short', 'too_short,no_procedural_content'])[form + 1] AS thin, ([true, true, false, false])[form + 1] AS overlong, count(*) AS n FROM x GROUP BY ALL",
    "m9_label_leaks": f"WITH {_ORDERS} SELECT o_orderkey, 'answer' AS field FROM o WHERE k < 2 AND length(t::VARCHAR) > 2 UNION ALL SELECT o_orderkey, 'segment' FROM o JOIN customer ON c_custkey = c WHERE k % 3 = 0 AND c_mktsegment = 'BUILDING'",
    "m10_total_faults": "WITH a AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ALL) SELECT o_orderkey, 'lines' AS field, n AS parts, CASE WHEN o_orderkey % 97 = 5 THEN 0 ELSE n + 1 END AS total FROM a WHERE o_orderkey % 97 = 5 OR o_orderkey % 50 = 3 UNION ALL SELECT o_orderkey, 'quantity', q, 0 FROM a WHERE o_orderkey % 97 = 5",
    "m11_strategy_faults": f"WITH {_ORDERS} SELECT * FROM (SELECT 'missing:steps' AS \"check\", count(*) AS n FROM o WHERE k = 2 UNION ALL SELECT 'leak', count(*) FROM o WHERE k = 0 UNION ALL SELECT 'coverage', count(*) FROM o WHERE c < 10 UNION ALL SELECT 'duplicate', greatest((SELECT count(*) FROM o WHERE k = 1) - 1, 0) + (SELECT count(*) - count(DISTINCT t) FROM o WHERE k = 0)) WHERE n > 0",
    "m12_truncation": "WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), s AS (SELECT doc_id, list_sum(list_transform(p, lambda x: length(x)))::BIGINT AS chars, list_sum(list_transform(p, lambda x: least(length(x), 600)))::BIGINT AS kept FROM p) SELECT doc_id, chars, kept, round(CASE WHEN chars = 0 THEN 0 ELSE 1 - kept / chars::DOUBLE END, 9) AS lost_share FROM s",
    "n3_case_records": rf"""WITH {_TABLE}, x AS (SELECT *, regexp_extract_all(program, '([a-z_]+)\(', 1) AS ops FROM p) SELECT o_orderkey, '{{"id":' || o_orderkey || ',"program":"' || program || '"' || CASE WHEN k <> 3 THEN ',"question":"price of ' || c || '"' ELSE '' END || ',"structure":"' || array_to_string(ops, '>') || '"}}' AS record, array_to_string(list_transform(ops, lambda o, i: 'Step ' || i || ': ' || MAP {{{', '.join(f"'{a}': '{b}'" for a, b in R.STEP_TEXT.items())}}}[o] || CASE WHEN i > 1 THEN ' using the result so far' ELSE '' END || '.'), ' ') AS strategy FROM x""",
    "n7_numeric_features": rf"WITH {_TABLE} SELECT o_orderkey, 20::BIGINT AS size, (59 + length(c::VARCHAR))::DOUBLE AS q_chars, 2.0::DOUBLE AS q_numbers, 1.0::DOUBLE AS q_change, (1 + len(qs))::DOUBLE AS t_cells, len(regexp_extract_all(program, '[a-z_]+\('))::DOUBLE AS p_steps, len(regexp_extract_all(program, 'table_'))::DOUBLE AS p_table, len(regexp_extract_all(program, '#[0-9]+'))::DOUBLE AS p_references FROM p",
    "o3_called": "WITH x AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 8 <> 0) SELECT CASE WHEN n % 7 = 3 OR n % 5 = 1 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 7 = 3 THEN 'RuntimeError: busy' END AS error, count(*) AS n, count(*) FILTER (n % 7 <> 3) AS answered FROM x GROUP BY 1, 2",
    "o5_parsed": "WITH x AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 7 = 3 OR o_orderkey % 11 = 4 THEN 2 WHEN o_orderkey % 5 = 1 THEN 1 ELSE 0 END AS r FROM orders) SELECT r AS round, CASE WHEN n % 7 = 3 THEN 'RuntimeError: busy' END AS error, CASE WHEN n % 7 <> 3 THEN (n % 4)::VARCHAR END AS answer, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "o6_arms": "WITH x AS (SELECT o_orderkey AS n, arm FROM orders, (VALUES ('none'), ('case')) a(arm)), y AS (SELECT arm, n % 3 AS gold, CASE WHEN n % 7 = 3 THEN 'RuntimeError: busy' WHEN n % 11 = 4 THEN 'no_json' END AS error, n FROM x) SELECT arm, error, coalesce(error IS NULL AND n % 4 = gold, false) AS correct, count(*) AS n FROM y GROUP BY 1, 2, 3",
    "o7_regenerated": "WITH x AS (SELECT o_orderkey % 3 AS m FROM orders) SELECT m AS round, CASE WHEN m = 2 THEN 'number' ELSE '' END AS faults, count(*) AS n FROM x GROUP BY ALL",
}
