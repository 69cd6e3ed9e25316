"""Golden cases of the program language, numbers, sources and the streaming log."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import numbers as N
from quillspark.functions import programs as P
from quillspark.functions import rules as K
from quillspark.functions import text as X
from quillspark.operators import integrity, outcomes, retrieval, stats
from quillspark.shipping import ship
from quillspark.sources import files
from quillspark.streaming import logs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ("subtract(72.5, 2.5), divide(#0, const_2)", 35.0),
        ("add(#0, 1)", None),
        ("add(1 2)", None),
        ("divide(1, 0)", None),
        ("exp(-8, 0.5)", None),
        ("table_sum(cash, none)", 3.5),
        ("table_average(debt, none)", None),
        ("multiply(50%, const_m1)", -0.5),
        ("power(1, 2)", None),
        ("", None),
    ],
)
def test_linear_programs(spark, program, want):
    table = F.array(*(F.array(*map(F.lit, r)) for r in (("item", "2018", "2019"), ("cash", "9", "9"), ("Cash", "$1,0", "-6.5 (x)"), ("debt", "n/a", "2"))))
    got = one(spark, P.answer(P.execute(P.parse_linear(F.lit(program)), table)).alias("a")).a
    assert got == want


def test_nested_programs(spark):
    ship(spark)
    df = spark.createDataFrame([("divide(subtract(10, 4), 4)",), ("add(1, 2",), ("add(1, 2) x",), (None,), ("add(1)",)], "p string")
    got = df.select(P.parse_nested("p").alias("r")).select(P.answer(P.execute(F.col("r.steps"))).alias("a"), "r.error").collect()
    assert [tuple(r) for r in got] == [(1.5, None), (None, "bracket"), (None, "rest"), (None, "empty"), (None, "arity")]


def test_numbers(spark):
    r = one(spark, N.strict_number(F.lit("$1,000")).alias("a"), N.strict_number(F.lit("4%")).alias("b"), N.lenient_number(F.lit("$1")).alias("c"), N.unsigned_number(F.lit("-5%")).alias("d"), N.last_number(F.lit("loss of (12.5)")).alias("e"), N.last_number(F.lit("none")).alias("f"), N.same_at(F.lit(1.000006), F.lit(1.0)).alias("g"))
    assert (r.a, r.b, r.c, r.d, r.e.value, r.f.value, r.g) == (1000.0, 0.04, None, 5.0, -12.5, None, False)


def test_tolerant_equality_names_the_kind_of_error(spark, small):
    from quillspark.plans import text

    kinds = {(r.k, r.kind) for r in text.QUERIES["h26_tolerant_equality"](spark, small).select((F.col("o_orderkey") % 6).alias("k"), "kind").distinct().collect()}
    assert kinds == set(enumerate(["correct", "percent_scale", "percent_scale", "thousands_scale", "small_error", "wrong"]))
    r = one(spark, N.error_class(F.lit(None).cast("double"), F.lit(1.0)).alias("a"), N.error_class(F.lit(0.0), F.lit(50.0)).alias("b"), N.error_class(F.lit(3.0), F.lit(0.0)).alias("c"))
    assert (r.a, r.b, r.c) == ("missing", "zero_result", "wrong")


def test_text(spark):
    r = one(spark, X.html_to_text(F.lit("<table><tr><td>a</td><td></td><td>b</td></tr><tr><td></td></tr></table>")).alias("a"), K.plain_answer(F.lit("The cat, of 1,000!")).alias("b"), X.json_object(F.lit("x {\"a\": 1} y")).alias("c"), X.truncate(F.lit("abcdef"), 3).alias("d"))
    assert (r.a, r.b, r.c, r.d) == ("a | b", "cat of 1000", '{"a": 1}', "abc...")


def test_mcnemar(spark):
    assert round(one(spark, stats.mcnemar_p(F.lit(32), F.lit(23)).alias("p")).p, 10) == 0.2806097177
    assert one(spark, stats.mcnemar_p(F.lit(0), F.lit(0)).alias("p")).p == 1.0


def test_outcomes_of_an_empty_table(spark):
    e = spark.createDataFrame([], "sample_id long, arm string, replicate int, correct boolean")
    assert outcomes.fixed_and_oracle(e).count() == 0
    assert outcomes.transfer(e).count() == 0


def test_top_k_ties_and_exclusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [3.0, 0.0], "b"), (4, None, "b")], "id long, vector array<double>, grp string")
    q, s = v.withColumnRenamed("id", "target_id"), v.withColumnRenamed("id", "source_id")
    got = {(r.target_id, r["rank"], r.source_id) for r in retrieval.top_k(q, s, 2).collect()}
    assert got == {(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)}
    assert {(r.target_id, r.source_id) for r in retrieval.top_k(q, s, 2, exclude="same").collect()} == {(1, 3), (2, 3), (3, 1), (3, 2)}


def test_cache_and_drift(spark):
    c = spark.createDataFrame([("a", "m1"), ("b", "m2")], "key string, model string")
    w = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r.key for r in integrity.misses(w, c).collect()] == ["z"]
    assert integrity.drifted(c, "model").count() == 1


def test_publish_keeps_the_old_table_on_a_failed_check(spark, tmp_path):
    path = str(tmp_path / "t")
    files.publish(spark, spark.range(3), path)
    with pytest.raises(ValueError):
        files.publish(spark, spark.range(5), path, check=lambda d: d.where("id > 3"))
    assert spark.read.parquet(path).count() == 3
    files.publish(spark, spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_json_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n')
    good, bad = files.read_json_split(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert [r.a for r in good.collect()] == [1] and [r.line for r in bad.collect()] == ["not json"]
    files.write_json_lines(spark.range(2).withColumn("b", F.lit("x")), str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ['{"b":"x","id":0}', '{"b":"x","id":1}']
    assert files.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"
    digest = files.digests(spark, str(tmp_path / "x.jsonl")).first().sha256
    files.check_lock(spark, str(tmp_path / "x.jsonl"), digest, 2)
    with pytest.raises(ValueError):
        files.check_lock(spark, str(tmp_path / "x.jsonl"), "0" * 64)


def test_streaming_log(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.unionByName(e).repartition(3).write.parquet(str(tmp_path / "in"))
    log = logs.read_log(spark, str(tmp_path / "in"), e.schema)
    logs.run_to_end(logs.once_each(log, "event_id", "ts", "60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
