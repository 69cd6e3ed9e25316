"""Queries of the program language; programs and tables are built from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import programs as P
from ..shipping import ship


def _programs(spark, sf_dir):
    """(o_orderkey, program, table, gold): seven kinds of programs, good and bad, over each order's lines."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("t"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("qs"))
    j = o.join(rows, "o_orderkey").withColumn("k", F.col("o_orderkey") % 7)
    t = F.col("t").cast("string")
    program = (
        F.when(F.col("k") == 0, F.concat(F.lit("subtract("), t, F.lit(", 100), divide(#0, const_2)")))
        .when(F.col("k") == 1, F.lit("table_sum(quantity, none)"))
        .when(F.col("k") == 2, F.concat(F.lit("table_max(quantity, none), add(#0, "), t, F.lit(")")))
        .when(F.col("k") == 3, F.concat(F.lit("divide("), t, F.lit(", 0)")))
        .when(F.col("k") == 4, F.concat(F.lit("greater("), t, F.lit(", 150000)")))
        .when(F.col("k") == 5, F.lit("add(#0, 1)"))
        .otherwise(F.lit("multiply(50%, const_100), table_average(weight, none)"))
    )
    table = F.array(F.concat(F.array(F.lit("item")), F.transform("qs", lambda q: F.lit("n"))), F.concat(F.array(F.lit("quantity")), F.transform("qs", lambda q: F.concat(F.lit("$"), q.cast("string")))))
    return j.select("o_orderkey", program.alias("program"), table.alias("table"), F.col("t").cast("double").alias("t"))


def j10(spark, sf_dir):
    p = _programs(spark, sf_dir).withColumn("steps", P.parse_linear(F.col("program")))
    p = p.withColumn("run", P.execute(F.col("steps"), F.col("table")))
    return p.select("o_orderkey", P.answer(F.col("run")).alias("answer"), F.col("run.flag").alias("flag"), P.failure(F.col("program"), F.col("steps"), F.col("run"), F.lit(True)).alias("status"))


def j17(spark, sf_dir):
    p = _programs(spark, sf_dir).withColumn("template", P.template(P.parse_linear(F.col("program"))))
    return p.groupBy("template").agg(F.count("*").alias("n"))


def j22(spark, sf_dir):
    p = _programs(spark, sf_dir).withColumn("ops", P.operations(F.col("program")))
    return p.groupBy(F.array_join("ops", ">").alias("struct"), P.op_family(F.col("ops")).alias("family"), P.bucket(F.col("ops"), F.col("program")).alias("bucket")).agg(F.count("*").alias("n"))


def j15(spark, sf_dir):
    """Trace: one row a step with its arguments and value."""
    p = _programs(spark, sf_dir).withColumn("steps", P.parse_linear(F.col("program"))).withColumn("run", P.execute(F.col("steps"), F.col("table"))).where("steps is not null")
    z = F.arrays_zip(F.col("steps").alias("s"), F.col("run.vals").alias("v"))
    return p.select("o_orderkey", F.posexplode(z).alias("step", "z")).select("o_orderkey", F.col("step").cast("long").alias("step"), "z.s.op", "z.s.a", F.round("z.v", 5).alias("value"))


def j8(spark, sf_dir):
    p = _programs(spark, sf_dir)
    r = F.concat(F.lit("Let me think.\nprogram: compare("), F.col("t").cast("long").cast("string"), F.lit(", 5)\nsubtract(#0, 1),\nANSWER: 3"))
    return p.select("o_orderkey", P.clean_program(P.program_of_response(r)).alias("program"))


def j3(spark, sf_dir):
    """Nested programs parsed in post-order and run."""
    ship(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").cast("long").cast("string").alias("t"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("divide(subtract("), F.col("t"), F.lit(", 100), const_4)"))).when(k == 1, F.concat(F.lit("add("), F.col("t"), F.lit(", multiply(2, 3)"))).when(k == 2, F.concat(F.lit("add(multiply(2, 3), "), F.col("t"), F.lit(")"))).otherwise(F.lit("power(1, 2)"))
    p = o.withColumn("p", P.parse_nested(text))
    return p.select("o_orderkey", P.answer(P.execute(F.col("p.steps"))).alias("answer"), F.col("p.error").alias("error"))


def j16(spark, sf_dir):
    """Programs that are equal up to the order of operands."""
    ship(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey").cast("string")
    a = P.parse_nested(F.concat(F.lit("add(multiply(2, "), k, F.lit("), 7)")))
    b = P.parse_nested(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("add(7, multiply("), k, F.lit(", 2))"))).otherwise(F.concat(F.lit("subtract(7, multiply("), k, F.lit(", 2))"))))
    p = o.withColumn("a", a).withColumn("b", b)
    return p.select("o_orderkey", (P.canonical_form(F.col("a.steps")) == P.canonical_form(F.col("b.steps"))).alias("equal"))


def j18(spark, sf_dir):
    """Share of right answers by failure kind against the expected value."""
    p = _programs(spark, sf_dir).withColumn("steps", P.parse_linear(F.col("program"))).withColumn("run", P.execute(F.col("steps"), F.col("table")))
    gold = F.when(F.col("o_orderkey") % 7 == 0, (F.col("t") - 100) / 2)
    right = N.same_at(P.answer(F.col("run")), gold)
    return p.groupBy(P.failure(F.col("program"), F.col("steps"), F.col("run"), right).alias("status")).agg(F.count("*").alias("n"))


_B = "b AS (SELECT o_orderkey, o_orderkey % 7 AS k, floor(o_totalprice)::BIGINT AS t, qs FROM orders JOIN (SELECT l_orderkey AS o_orderkey, list(l_quantity::BIGINT) AS qs FROM lineitem GROUP BY ALL) USING (o_orderkey))"
QUERIES = {"j3_nested_programs": j3, "j8_program_of_response": j8, "j10_execute_programs": j10, "j15_trace": j15, "j16_equal_programs": j16, "j17_templates": j17, "j18_status_counts": j18, "j22_operations": j22}
ORACLES = {
    "j3_nested_programs": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round((floor(o_totalprice) - 100) / 4, 5) WHEN 2 THEN 6 + floor(o_totalprice) END AS answer, CASE o_orderkey % 4 WHEN 1 THEN 'bracket' WHEN 3 THEN 'operator' END AS error FROM orders",
    "j8_program_of_response": f"WITH {_B} SELECT o_orderkey, 'greater(' || t || ', 5), subtract(#0, 1)' AS program FROM b",
    "j10_execute_programs": f"WITH {_B} SELECT o_orderkey, CASE k WHEN 0 THEN (t - 100) / 2 WHEN 1 THEN list_sum(qs) WHEN 2 THEN list_max(qs) + t WHEN 4 THEN (t > 150000)::INT END::DOUBLE AS answer, CASE WHEN k = 4 THEN CASE WHEN t > 150000 THEN 'yes' ELSE 'no' END END AS flag, CASE WHEN k IN (3, 6) THEN 'exec_fail' WHEN k = 5 THEN 'parse_fail' ELSE 'success' END AS status FROM b",
    "j15_trace": f"""WITH {_B} SELECT * FROM (SELECT o_orderkey, 0::BIGINT AS step, CASE k WHEN 0 THEN 'subtract' WHEN 1 THEN 'table_sum' WHEN 2 THEN 'table_max' WHEN 3 THEN 'divide' WHEN 4 THEN 'greater' ELSE 'multiply' END AS op, CASE WHEN k IN (0, 3, 4) THEN t::VARCHAR WHEN k IN (1, 2) THEN 'quantity' ELSE '50%' END AS a, CASE k WHEN 0 THEN t - 100 WHEN 1 THEN list_sum(qs) WHEN 2 THEN list_max(qs) WHEN 4 THEN (t > 150000)::INT WHEN 6 THEN 50 END::DOUBLE AS value FROM b WHERE k <> 5
UNION ALL SELECT o_orderkey, 1, CASE k WHEN 0 THEN 'divide' WHEN 2 THEN 'add' ELSE 'table_average' END, CASE k WHEN 6 THEN 'weight' ELSE '#0' END, CASE k WHEN 0 THEN (t - 100) / 2 WHEN 2 THEN list_max(qs) + t END::DOUBLE FROM b WHERE k IN (0, 2, 6))""",
    "j16_equal_programs": "SELECT o_orderkey, o_orderkey % 2 = 0 AS equal FROM orders",
    "j17_templates": f"WITH {_B} SELECT (['subtract(NUM, NUM), divide(#0, CONST)', 'table_sum(ROW, none)', 'table_max(ROW, none), add(#0, NUM)', 'divide(NUM, NUM)', 'greater(NUM, NUM)', NULL, 'multiply(PCT, CONST), table_average(ROW, none)'])[k + 1] AS template, count(*) AS n FROM b GROUP BY ALL",
    "j18_status_counts": f"WITH {_B} SELECT CASE WHEN k IN (3, 6) THEN 'exec_fail' WHEN k = 5 THEN 'parse_fail' WHEN k = 0 THEN 'success' ELSE 'wrong_result' END AS status, count(*) AS n FROM b GROUP BY ALL",
    "j22_operations": f"WITH {_B} SELECT (['subtract>divide', 'table_sum', 'table_max>add', 'divide', 'greater', 'add', 'multiply>table_average'])[k + 1] AS struct, (['change', 'table_aggregation', 'table_aggregation', 'ratio', 'comparison', 'aggregation', 'table_aggregation'])[k + 1] AS family, (['F', 'B', 'B', 'G', 'A', 'G', 'B'])[k + 1] AS bucket, count(*) AS n FROM b GROUP BY ALL",
}
