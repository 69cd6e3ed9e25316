"""Queries of derivations, answer metrics, rendering, abstraction checks and selectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import derivations as D
from ..operators import abstractions as B
from ..operators import metrics as E
from ..operators import outcomes as O
from ..operators import rendering as R
from ..operators import retrieval as V
from ..operators import selectors as L
from ..operators import tables as T
from ..shipping import ship
from .outcomes import ARMS_SQL, arms


def _derivations(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").cast("long").cast("string").alias("t"))
    k = F.col("o_orderkey") % 6
    a = F.lit
    x = (
        F.when(k == 0, F.concat(a("("), F.col("t"), a(" - 100) / 100")))
        .when(k == 1, F.concat(F.col("t"), a(" / 2")))
        .when(k == 2, F.concat(F.col("t"), a(" - -5")))
        .when(k == 3, F.concat(F.col("t"), a(" + 1,000 + $3.5")))
        .when(k == 4, F.concat(a("(("), F.col("t"), a(" + 2) * 3) / 4")))
        .otherwise(a("see note"))
    )
    return o.select("o_orderkey", x.alias("d"))


def h15(spark, sf_dir):
    t = D.tokens(F.col("d"))
    return _derivations(spark, sf_dir).select("o_orderkey", F.array_join(t, " ").alias("tokens"), F.array_join(D.operators(t), ">").alias("ops"), D.operand_count(t).cast("long").alias("operands"), D.depth(t).cast("long").alias("depth"), D.family(t).alias("family"))


def h31(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("t"))
    t = F.col("t").cast("string")
    program = F.concat(F.lit("divide("), t, F.lit(", 100), add(#0, 77), subtract(#1, 2019)"))
    context = F.concat(F.lit("total $"), F.format_number("t", 0), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" and 77")).otherwise(F.lit(" and 1")))
    w = D.operands(program)
    return o.select("o_orderkey", F.size(w).cast("long").alias("wanted"), F.round(D.coverage(w, context), 6).alias("coverage"))


def k3(spark, sf_dir):
    """Answers in several forms against golds: numbers with scales, spans in another order, empty answers."""
    ship(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey") % 5
    n = F.col("o_orderkey").cast("string")
    ar = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    q = o.select(
        "o_orderkey",
        F.when(k == 0, ar(n)).when(k == 1, ar("4.6")).when(k == 2, ar("2018", "2019")).when(k == 3, ar("the red cat")).otherwise(ar(n)).alias("gold"),
        F.when(k == 1, "percent").otherwise("").alias("gs"),
        F.when(k == 2, "multi-span").when(k == 3, "span").otherwise("arithmetic").alias("kind"),
        F.when(k == 0, ar(F.format_number("o_orderkey", 0))).when(k == 1, ar("0.046")).when(k == 2, ar("2019", "2018")).when(k == 3, ar("red dog")).otherwise(F.array().cast("array<string>")).alias("pred"),
    )
    m = E.qa(F.col("gold"), F.col("gs"), F.col("kind"), F.col("pred"), F.lit(""))
    return q.withColumn("m", m).groupBy("kind", (k == 4).alias("empty"), "gs").agg(F.count("*").alias("n"), F.avg("m.em").alias("em"), F.avg("m.f1").alias("f1"), F.avg("m.scale_right").alias("scale_right"))


def n1(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row = F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_quantity").cast("long").cast("string"))
    t = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("t"))
    return t.select("l_orderkey", R.context_text(F.array(F.lit("intro"), F.concat(F.lit("order "), F.col("l_orderkey"))), F.col("t"), F.array().cast("array<string>")).alias("context"))


def n4(spark, sf_dir):
    g = R.groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "source", "doc_id", 5)
    return g.select("source", "support", "prototype", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def i7(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    v = R.variants(c, question_only=F.col("role"), full_context=F.concat_ws(" ", "role", F.col("turn").cast("string")))
    return v.groupBy("variant", "text").agg(F.count("*").alias("n"))


def n6(spark, sf_dir):
    a = arms(spark, sf_dir).where("replicate = 0")
    return a.groupBy("arm").agg(F.max(F.length(R.memory_block(F.col("arm"), F.lit("c1"), F.lit("s1")))).cast("long").alias("chars"), F.count("*").alias("n"))


def _strategies(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "Divide the difference of both amounts by the earlier amount").when(k == 1, "Add both amounts and compare with the earlier total").when(k == 2, "go go go go go go go go").otherwise(F.concat(F.lit("Subtract and divide to get order "), F.col("o_orderkey")))
    return o.select("o_orderkey", text.alias("s"), F.array(F.lit("subtract"), F.lit("divide")).alias("ops"))


def m6(spark, sf_dir):
    f = B.fidelity(F.col("ops"), F.col("s"))
    return _strategies(spark, sf_dir).select("o_orderkey", F.array_join(f["extra"], ",").alias("extra"), F.array_join(f["missing"], ",").alias("missing"), B.degenerate(F.col("s")).alias("degenerate"), F.coalesce(B.contaminated(F.col("ops"), F.col("s"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))), F.lit(False)).alias("contaminated"))


def m13(spark, sf_dir):
    w = O.wide(arms(spark, sf_dir), ("none", "both"))
    return w.groupBy(B.outcome_class(F.col("none"), F.col("both")).alias("outcome")).agg(F.count("*").alias("n"))


def d25(spark, sf_dir):
    a = O.accuracy(arms(spark, sf_dir), "replicate").groupBy("arm").agg(F.min("accuracy").alias("least"), F.avg("accuracy").alias("mean"), F.max("accuracy").alias("greatest"), (F.max("accuracy") - F.min("accuracy")).alias("span"))
    return a.select("arm", *(F.round(c, 9).alias(c) for c in ("least", "mean", "greatest", "span")))


def d43(spark, sf_dir):
    a = arms(spark, sf_dir)
    flag = (F.col("cust") % 3 == 0).alias("same_company")
    return a.groupBy("arm", flag).agg(F.count("*").alias("n"), F.round(F.avg(O.hit()), 9).alias("accuracy"))


def c7(spark, sf_dir):
    """Containment join: a case's structure is one of the families of a strategy."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy("event_id", "event_type"))).where("_r <= 2")
    e = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "event_type"))), lambda s: s["event_type"]), ">").alias("struct"))
    s = spark.createDataFrame([(1, ["view>click", "click>view"]), (2, ["view>view", "purchase>view", "click>view"])], "strategy_id long, families array<string>")
    fam = s.select("strategy_id", F.explode("families").alias("struct"))
    return e.join(F.broadcast(fam), "struct").groupBy("strategy_id").agg(F.count_distinct("user_id").alias("users"))  # the catalogue is a fixed list


def g1(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    la = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    a, b = d.select("doc_id"), la
    return a.intersect(b).agg(F.count("*").alias("shared")).crossJoin(a.exceptAll(b).agg(F.count("*").alias("only_documents"))).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_labels")))  # one row each


def i12(spark, sf_dir):
    """Two lists of ids that should stand in one order: by id, and as a side file has them after some rows were swapped and lost."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("row"))
    moved = F.when(F.col("row") % 50 == 7, F.col("row") + 1).when(F.col("row") % 50 == 8, F.col("row") - 1).otherwise(F.col("row"))
    side = o.where("row % 1000 <> 999").select("o_orderkey", moved.alias("row"))
    return V.index_defects(o, side, "row", "o_orderkey").select("row", "a", F.coalesce("b", F.lit(-1)).alias("b"))


def l3(spark, sf_dir):
    """Grouped folds: no group in two folds, loads within the largest group of each other."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    f = o.join(L.group_folds(o, "o_custkey", 5), "o_custkey")
    return f.groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("groups"))


def l4(spark, sf_dir):
    """Selector: probability that an arm beats the base from an open feature map, thresholds by one standard error."""
    a = arms(spark, sf_dir).where("replicate = 0")
    w = O.wide(a, ("case", "both"), ("sample_id", "cust", "grp"))
    x = w.withColumn("features", F.map_from_arrays(F.array(F.lit("mod5"), F.concat(F.lit("grp="), F.col("grp")), F.lit("mod101")), F.array((F.col("sample_id") % 5).cast("double"), F.lit(1.0), (F.col("sample_id") * 11 % 101).cast("double"))))
    x = x.withColumn("gain", F.col("case") & ~F.col("both"))
    p = L.cross_validated(x, "features", "gain", "cust")
    t = L.threshold_table(p, "case", "both", [0.0, 0.3, 0.5, 0.7, 1.0])
    c = t.select(F.concat(F.lit("t="), F.col("threshold").cast("string")).alias("name"), "mean", "se", "coverage", (F.col("threshold") >= 1).alias("always_base"), "threshold", F.col("mean").alias("metric"))
    return T.one_standard_error(c)


QUERIES = {"c7_containment_join": c7, "d25_realised_by_replicate": d25, "d43_conditioned_accuracy": d43, "g1_set_checks": g1, "h15_derivations": h15, "h31_operand_coverage": h31, "i7_text_variants": i7, "i12_index_defects": i12, "k3_answer_metrics": k3, "l3_group_folds": l3, "l4_selector": l4, "m6_abstraction_checks": m6, "m13_before_after": m13, "n1_render_context": n1, "n4_strategy_groups": n4, "n6_memory_blocks": n6}
_O = "b AS (SELECT o_orderkey, o_orderkey % 6 AS k, floor(o_totalprice)::BIGINT AS t FROM orders)"
ORACLES = {
    "c7_containment_join": "WITH e AS (SELECT user_id, array_to_string(list(event_type ORDER BY event_id)[1:2], '>') AS struct FROM events GROUP BY user_id), f AS (SELECT * FROM (VALUES (1, 'view>click'), (1, 'click>view'), (2, 'view>view'), (2, 'purchase>view'), (2, 'click>view')) f(strategy_id, struct)) SELECT strategy_id::BIGINT AS strategy_id, count(DISTINCT user_id) AS users FROM e JOIN f USING (struct) GROUP BY ALL",
    "d25_realised_by_replicate": f"WITH {ARMS_SQL}, g AS (SELECT arm, replicate, avg(correct::INT) AS a FROM arms GROUP BY ALL) SELECT arm, round(min(a), 9) AS least, round(avg(a), 9) AS mean, round(max(a), 9) AS greatest, round(max(a) - min(a), 9) AS span FROM g GROUP BY arm",
    "d43_conditioned_accuracy": f"WITH {ARMS_SQL} SELECT arm, cust % 3 = 0 AS same_company, count(*) AS n, round(avg(correct::INT), 9) AS accuracy FROM arms GROUP BY ALL",
    "g1_set_checks": "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS only_documents, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS only_labels",
    "h15_derivations": f"WITH {_O} SELECT o_orderkey, (['( O1 - O2 ) / O3', 'O1 / O2', 'O1 - O2', 'O1 + O2 + O3', '( ( O1 + O2 ) * O3 ) / O4', 'WORD'])[k + 1] AS tokens, (['subtract>divide', 'divide', 'subtract', 'add>add', 'add>multiply>divide', ''])[k + 1] AS ops, ([3, 2, 2, 3, 4, 0]::BIGINT[])[k + 1] AS operands, ([1, 0, 0, 0, 2, 0]::BIGINT[])[k + 1] AS depth, (['percent_change', 'ratio', 'difference', 'aggregation', 'division_composition', 'unparsed'])[k + 1] AS family FROM b",
    "h31_operand_coverage": f"WITH {_O}, w AS (SELECT o_orderkey, (t NOT IN (0, 1, 77, 100) AND t >= 10 AND NOT t BETWEEN 1900 AND 2099)::INT AS own, (o_orderkey % 2 = 0 OR t::VARCHAR LIKE '%77%')::INT AS more FROM b) SELECT o_orderkey, (own + 1)::BIGINT AS wanted, round((own + more) / (own + 1), 6) AS coverage FROM w",
    "i7_text_variants": "SELECT 'question_only' AS variant, role AS text, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT 'full_context', role || ' ' || turn, count(*) FROM conversations GROUP BY ALL",
    "i12_index_defects": "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 50 WHEN 7 THEN o_orderkey + 1 WHEN 8 THEN o_orderkey - 1 ELSE o_orderkey END AS r FROM orders WHERE o_orderkey % 1000 <> 999) SELECT coalesce(o.o_orderkey, s.r) AS row, o.o_orderkey AS a, coalesce(s.o_orderkey, -1) AS b FROM orders o FULL JOIN s ON s.r = o.o_orderkey WHERE o.o_orderkey IS DISTINCT FROM s.o_orderkey",
    "k3_answer_metrics": "SELECT CASE o_orderkey % 5 WHEN 2 THEN 'multi-span' WHEN 3 THEN 'span' ELSE 'arithmetic' END AS kind, o_orderkey % 5 = 4 AS empty, CASE WHEN o_orderkey % 5 = 1 THEN 'percent' ELSE '' END AS gs, count(*) AS n, avg(CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN 1.0 ELSE 0.0 END) AS em, avg(CASE o_orderkey % 5 WHEN 3 THEN 0.5 WHEN 4 THEN 0.0 ELSE 1.0 END) AS f1, avg(CASE WHEN o_orderkey % 5 = 1 THEN 0.0 ELSE 1.0 END) AS scale_right FROM orders GROUP BY ALL",
    "m6_abstraction_checks": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'add,greater' ELSE '' END AS extra, CASE o_orderkey % 4 WHEN 1 THEN 'divide,subtract' WHEN 2 THEN 'divide,subtract' ELSE '' END AS missing, o_orderkey % 4 = 2 AS degenerate, o_orderkey % 4 <> 0 AS contaminated FROM orders",
    "m13_before_after": f"WITH {ARMS_SQL} SELECT CASE WHEN NOT none_ AND both_ THEN 'repaired' WHEN none_ AND NOT both_ THEN 'broken' WHEN none_ THEN 'unchanged_right' ELSE 'unchanged_wrong' END AS outcome, count(*) AS n FROM wide GROUP BY ALL",
    "n1_render_context": "SELECT l_orderkey, 'TEXT:' || chr(10) || 'intro' || chr(10) || 'order ' || l_orderkey || chr(10) || chr(10) || 'TABLE:' || chr(10) || string_agg(l_linenumber || ' | ' || l_returnflag || ' | ' || l_quantity::BIGINT, chr(10) ORDER BY l_linenumber::VARCHAR, l_returnflag, l_quantity::BIGINT::VARCHAR) AS context FROM lineitem GROUP BY l_orderkey",
    "n4_strategy_groups": "SELECT source, count(*) AS support, min(doc_id) AS prototype, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS ids FROM documents GROUP BY source",
    "n6_memory_blocks": f"WITH {ARMS_SQL} SELECT arm, CASE arm WHEN 'case' THEN 9 WHEN 'strategy' THEN 14 WHEN 'both' THEN 25 ELSE 0 END::BIGINT AS chars, count(*) AS n FROM arms WHERE replicate = 0 GROUP BY ALL",
}
