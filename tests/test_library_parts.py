"""Runs, policies, executors and sources beyond what the queries show."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import arrays as A
from quillspark.functions import programs as P
from quillspark.functions import text as X
from quillspark.operators import integrity, outcomes, policies, retrieval, runs, stats, tables
from quillspark.sources import files
from quillspark.streaming import logs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ("add(1, 2)", (False, 3.0)),
        ("add(1, 2), divide(#0, 0)", (True, None)),
        ("table_sum(cash, none)", (False, 3.5)),
        ("table_sum(Cash, none)", (True, None)),
        ("table_sum(cash, none), table_max(#0, none)", (True, None)),
        ("add(1, 2), multiply(#0", (False, 3.0)),
        ("add(1, 2), power(#0", (True, None)),
        ("power(1, 2)", (True, None)),
        ("exp(-8, 0.5)", (True, None)),
        ("", (False, None)),
    ],
)
def test_official_runs(spark, program, want):
    table = F.array(*(F.array(*map(F.lit, r)) for r in (("item", "2018"), ("cash", "9"), ("cash", "$3.5"))))
    got = one(spark, P.official_run(F.lit(program), table).alias("r")).r
    assert (got.invalid, got.value) == want


@pytest.mark.parametrize(("program", "error"), [("add(1, 2), add(#0, 3)", None), (None, "empty"), ("  ", "empty"), ("add(1, 2), , add(1, 2)", "part"), ("add(1, 2) x", "form"), ("power(1, 2)", "operator"), ("add(1)", "arity"), ("add(#0, 1)", "reference"), ("add(1, 2), add(#1, 1)", "reference")])
def test_linear_error_codes(spark, program, error):
    got = one(spark, P.parse_linear_coded(F.lit(program).cast("string")).alias("p")).p
    assert got.error == error and (got.steps is None) == (error is not None)


def test_required_programs_fail_the_query(spark):
    good, bad = (P.require(P.execute(P.parse_linear(F.lit(p))), F.lit(p)).alias("v") for p in ("add(1, 2)", "divide(1, 0)"))
    assert one(spark, good).v == 3.0
    with pytest.raises(Exception, match="does not execute"):
        one(spark, bad)


def test_edit_distance_of_any_items(spark):
    r = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rows = [([r.choice(["sum", "share", "s"]) for _ in range(r.randint(0, 6))], [r.choice(["sum", "share", "s"]) for _ in range(r.randint(0, 6))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", A.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == plain(x.a, x.b) for x in got)


def test_order_statistics_range_by_range(spark):
    r = random.Random(3)
    values = [r.choice([1.0, 2.5, 7.0]) if r.random() < 0.5 else round(r.random() * 100, 2) for _ in range(997)]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(values)], "v double, g string").repartition(5)
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    got = {x.v: x.before for x in tables.cumulative(counts, "v", "n").collect()}
    assert got == {v: sum(w < v for w in values) for v in set(values)}
    import numpy as np

    d = tables.distribution(df, "v").first()
    assert np.allclose([d.p50, d.p90, d.p95, d.mean], [*np.percentile(values, [50, 90, 95]), np.mean(values)])
    ranks = {(x.g, x.v): x["rank"] for x in stats.average_ranks(df, "v", "g").collect()}
    for g in "ab":
        own = [v for i, v in enumerate(values) if "ab"[i % 2] == g]
        assert all(ranks[g, v] == sum(w < v for w in own) + (own.count(v) + 1) / 2 for v in set(own))
    assert tables.distribution(df.limit(0), "v").count() <= 1 and tables.terciles(df.limit(0), "v", "g").count() == 0


def test_best_columns():
    import numpy as np

    s = np.random.default_rng(0).integers(0, 5, (40, 30)).astype(float)
    for k in (1, 3, 30, 50):
        got = retrieval.best_columns(s, k)
        for i in range(len(s)):
            want = sorted(range(30), key=lambda j: (-s[i, j], j))[:k]
            assert sorted(got[i].tolist()) == sorted(want)


def test_calls_with_retries_and_dead_letters(spark):
    def call(prompt, attempt):
        if prompt == "never" or (prompt == "later" and attempt < 2):
            raise ValueError("busy")
        return prompt.upper()

    df = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never")], "id long, prompt string")
    got = {r.id: (r.response, r.attempts, r.error) for r in runs.called(df, "id", "prompt", call, 3).collect()}
    assert got == {"1": ("NOW", 1, None), "2": ("LATER", 3, None), "3": (None, 3, "ValueError: busy")}
    assert runs.dead_letters(runs.called(df, "id", "prompt", call, 3)).count() == 1
    done = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.id for r in runs.resumed(df, done, "id").collect()] == [3]
    with pytest.raises(Exception, match="not in the cache"):
        runs.resumed(df, done, "id", dry_run=True).collect()
    assert runs.called(df.limit(0), "id", "prompt", call).count() == 0


@pytest.mark.parametrize("model", ["tree", "mlp", "logistic"])
def test_classifiers_and_regressors(spark, model):
    df = spark.createDataFrame([(i, i % 2 == 0, {"x": float(i % 2), "y": 1.0}) for i in range(60)], "id long, y boolean, f map<string,double>")
    p = policies.classify(df, df, "f", "y", model).collect()
    assert len(p) == 60 and all((r.p > 0.5) == r.y for r in p)
    if model != "mlp":
        y = policies.regress(df.withColumn("t", F.col("id") % 2), df, "f", "t", "ridge" if model == "logistic" else "tree").collect()
        assert max(r.predicted for r in y if r.id % 2 == 0) < min(r.predicted for r in y if r.id % 2 == 1)


def test_case_validator_finds_each_attack(spark):
    t = F.array(*(F.array(*map(F.lit, r)) for r in (("item", "2018", "2019"), ("cash", "9", "4"))))
    steps = P.parse_linear(F.lit("table_sum(cash, none), add(#0, 1)"))
    good = spark.range(1).select(F.lit("table_sum(cash, none), add(#0, 1)").alias("program"), t.alias("table"), steps.alias("steps"), F.array(F.lit(13.0), F.lit(14.0)).alias("vals"), integrity.grounding(steps, t).alias("grounding"), F.lit(14.0).alias("answer"))
    attacks = {
        "none": good,
        "contract": good.withColumn("answer", F.lit(None).cast("double")),
        "fidelity": good.withColumn("program", F.lit("table_sum(cash, none), add(#0, 2)")),
        "grounding": good.withColumn("grounding", F.transform_values("grounding", lambda k, v: F.transform(v, lambda x: x + 1))),
        "official": good.withColumn("answer", F.lit(15.0)),
        "values": good.withColumn("vals", F.array(F.lit(13.0), F.lit(15.0))),
        "short": good.withColumn("vals", F.array(F.lit(13.0))),
    }
    every = None
    for name, df in attacks.items():
        df = df.withColumn("id", F.lit(name))
        every = df if every is None else every.unionByName(df)
    found = {}
    for r in integrity.case_violations(every, "id").collect():
        found.setdefault(r.id, set()).add(r.check)
    assert found == {"contract": {"contract", "official"}, "fidelity": {"fidelity", "official"}, "grounding": {"grounding"}, "official": {"official"}, "values": {"grounding"}, "short": {"grounding"}}


def test_set_checks_assert(spark):
    a, b = spark.range(5), spark.range(3, 8)
    tables.require_empty(tables.shared_ids(a, spark.range(9, 12), "id"), "splits share ids")
    with pytest.raises(AssertionError, match="splits share ids"):
        tables.require_empty(tables.shared_ids(a, b, "id"), "splits share ids")
    assert {(r.id, r.side) for r in tables.set_differences(a, b, "id").collect()} == {(0, "missing"), (1, "missing"), (2, "missing"), (5, "extra"), (6, "extra"), (7, "extra")}


def test_json_document_has_one_form(spark, tmp_path):
    path = f"file://{tmp_path}/d.json"
    files.write_json_document(spark.createDataFrame([(2, "é"), (1, None)], "b long, a string").orderBy("b"), path)
    assert (tmp_path / "d.json").read_text() == '[\n  {\n    "b": 1\n  },\n  {\n    "a": "é",\n    "b": 2\n  }\n]\n'
    with pytest.raises(ValueError):
        files.write_json_document(spark.range(4), path, most=3)


def test_windowed_means_of_a_stream(spark, tmp_path):
    log = spark.createDataFrame([(i * 600, float(i), "a") for i in range(12)] + [(10**6, 0.0, "z")], "s long, v double, k string").select(F.timestamp_seconds("s").alias("at"), "v", "k")
    log.write.parquet(f"{tmp_path}/log")
    out = logs.windowed_means(logs.read_log(spark, f"{tmp_path}/log", log.schema), "at", "v", "k")
    for _ in range(2):
        logs.run_to_end(out, f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted((r.start.minute, r.k, r.n, r["mean"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.k == "a")
    assert [g[2:] for g in got] == [(6, 2.5), (6, 8.5)]


def test_hashed_vectors_of_odd_texts(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b a a")], "id long, text string")
    got = {r.id: r.vector for r in retrieval.hashed_vectors(d, "id", "text", 8).collect()}
    assert got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and set(got[2]) == set(got[3]) == {0.0}


def test_predictions_of_odd_entries(spark):
    for text, want in (('["1", "million"]', (["1"], "million", None)), ('["1", "2", "3"]', (["1", "2", "3"], "", None)), ("17", (["17"], "", None)), ('{"answer": {"answer": "x", "scale": "percent"}}', (["x"], "percent", None)), (None, ([], "", None))):
        got = one(spark, X.prediction(F.lit(text).cast("string")).alias("p")).p
        assert (got.answers, got.scale, got.program) == want, text


def test_transfer_without_other_runs(spark):
    df = spark.createDataFrame([(1, "none", 0, True)], "sample_id long, arm string, replicate int, correct boolean")
    assert outcomes.transfer(df).count() == 0


def test_texts_whose_signs_cancel_have_faults_as_in_sql(spark, tmp_path):
    import duckdb

    from quillspark.plans import audits

    texts = ["De éenéç, on ierè.", "Thhestly ou. Ha erbleti.", "", "...", "one", "one two three"]
    d = spark.createDataFrame([(40 * i + k, t) for i, t in enumerate(texts) for k in (0, 3, 5, 7)], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    plain, whole = ({r.doc_id: sum(x * x for x in r.vector) for r in retrieval.hashed_vectors(d, "doc_id", "text", 16, w).collect()} for w in (False, True))
    assert plain[0] == plain[40] == plain[80] == whole[80] == whole[120] == 0 and all(abs(whole[40 * i] - 1) < 1e-9 for i in (0, 1, 4, 5))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in audits.i11(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.sql(audits.ORACLES["i11_encoding_faults"]).fetchall())


def outcome_rows(spark):
    """Outcomes with repeated rows and unknown values, exploded from a few samples as the queries' are."""
    each = F.expr("explode(array('none', 'case', 'strategy', 'both'))").alias("arm")
    runs = spark.range(60).select(F.col("id").alias("sample_id"), each).select("*", F.expr("explode(sequence(0, 2))").alias("replicate"))
    mixed = F.abs(F.xxhash64("sample_id", "arm", "replicate"))
    return runs.select("*", F.when(mixed % 11 > 0, mixed % 3 == 0).alias("correct"), F.explode(F.sequence(F.lit(0), F.when(mixed % 7 == 0, 1).otherwise(0))).alias("copy"))


def in_sql(df, sql):
    import duckdb

    arms = df.toArrow()  # noqa: F841
    return duckdb.sql(sql).fetchall()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def near(got, want):
    got, want = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x) for x in (got, want))
    assert got == want


def test_agreement_sends_no_outcomes_to_the_driver(spark):
    df = outcome_rows(spark)
    got = outcomes.agreement(df)
    assert "Broadcast" not in plan(got)
    near(got.collect(), in_sql(df, "SELECT a.arm, a.replicate, b.replicate, avg((a.correct = b.correct)::INT) FROM arms a JOIN arms b ON a.sample_id = b.sample_id AND a.arm = b.arm AND a.replicate < b.replicate GROUP BY ALL"))


def test_transfer_joins_no_outcomes(spark):
    df = outcome_rows(spark)
    got = outcomes.transfer(df)
    assert plan(got).count("BroadcastExchange") <= 1 and "SortMergeJoin" not in plan(got)
    near(
        got.collect(),
        in_sql(
            df,
            """WITH k AS (SELECT f.fold, a.* FROM arms a, (VALUES (0), (1), (2)) f(fold) WHERE a.replicate <> f.fold), s AS (SELECT fold, sample_id, arm, avg(correct::INT) AS score FROM k GROUP BY ALL), o AS (SELECT fold, arm, avg(correct::INT) AS prior FROM k GROUP BY ALL),
            pick AS (SELECT fold, sample_id, arm FROM s JOIN o USING (fold, arm) QUALIFY row_number() OVER (PARTITION BY fold, sample_id ORDER BY score DESC NULLS LAST, prior DESC, arm) = 1)
            SELECT a.replicate, count(*), avg(a.correct::INT) FROM pick p JOIN arms a ON a.replicate = p.fold AND a.sample_id = p.sample_id AND a.arm = p.arm GROUP BY ALL""",
        ),
    )


def test_pareto_sends_no_costs_to_the_driver(spark):
    df = outcome_rows(spark).withColumn("tokens", F.col("sample_id") % 7 + F.length("arm"))
    got = outcomes.pareto(df.drop("tokens"), df.where("replicate = 0 and copy = 0").select("sample_id", "arm", "tokens"))
    assert "Broadcast" not in plan(got)
    near(got.collect(), in_sql(df, "WITH g AS (SELECT a.arm, avg(c.tokens) AS t, avg(a.correct::INT) AS a FROM arms a JOIN (SELECT * FROM arms WHERE replicate = 0 AND copy = 0) c USING (sample_id, arm) GROUP BY ALL) SELECT *, NOT EXISTS (SELECT 1 FROM g h WHERE h.arm <> g.arm AND h.t <= g.t AND h.a >= g.a) FROM g"))


def test_digests_of_files_that_are_no_row(spark, tmp_path, monkeypatch):
    import hashlib

    texts = {"a b.txt": b"x" * 5000 + b"\nend", "small.txt": b"one\ntwo\n"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files, "WHOLE", 100, raising=False)
    monkeypatch.setattr(files, "PIECE", 7, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # stands for the 2 GB of a row
    try:
        got = {r.path.rpartition("/")[2].replace("%20", " "): (r.bytes, r.sha256, r.md5) for r in files.digests(spark, str(tmp_path)).collect()}
        assert got == {k: (len(v), hashlib.sha256(v).hexdigest(), hashlib.md5(v).hexdigest()) for k, v in texts.items()}
        files.check_lock(spark, f"{tmp_path}/a*.txt", got["a b.txt"][1], 2)
        with pytest.raises(ValueError, match="match its lock"):
            files.check_lock(spark, f"{tmp_path}/a*.txt", got["small.txt"][1])
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
