"""Block digests, keyword rules, nested policies, alignments, accumulators and guards beyond what the queries show."""

import os
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.operators import accumulators, matching, nested, retrieval, stats
from quillspark.sources import blocks
from quillspark.streaming import guard


# -- block digests ----------------------------------------------------------------------------------
def test_one_byte_of_a_file_above_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 12_345
    for name in ("a", "b"):
        os.makedirs(tmp_path / name)
        with open(tmp_path / name / "big.bin", "wb") as f:
            f.truncate(size)  # a sparse file: no disk is taken
    with open(tmp_path / "b" / "big.bin", "r+b") as f:
        f.seek(1_500_000_000)
        f.write(b"x")
    big = 8 << 20
    trees = [blocks.tree(blocks.blocks(spark, f"file://{tmp_path}/{n}", big).withColumn("path", F.lit("big")), fan=16) for n in ("a", "b")]
    assert [r.blocks for r in blocks.roots(trees[0]).collect()] == [-(-size // big)]
    assert [tuple(r) for r in blocks.changed_blocks(*trees, fan=16).collect()] == [("big", 1_500_000_000 // big, "changed")]
    assert blocks.changed_blocks(trees[0], trees[0], fan=16).count() == 0


def test_blocks_added_removed_and_empty(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    for d in (old, new):
        os.makedirs(d)
    for d, name, data in ((old, "same", b"abcdefgh"), (new, "same", b"abcdefgh"), (old, "cut", b"abcdefgh"), (new, "cut", b"abcde"), (old, "gone", b"x"), (new, "none", b""), (new, "long", b"y" * 40)):
        (d / name).write_bytes(data)
    leaves = [blocks.blocks(spark, f"file://{d}", 2, content=True).withColumn("path", F.element_at(F.split("path", "/"), -1)) for d in (old, new)]
    assert bytes(leaves[0].where("path = 'same' and block = 1").first().content) == b"cd"
    a, b = (blocks.tree(x, fan=2) for x in leaves)
    got = {(r.path, r.block): r.change for r in blocks.changed_blocks(a, b, fan=2).collect()}
    want = {("cut", 2): "changed", ("cut", 3): "removed", ("gone", 0): "removed"} | {("long", i): "added" for i in range(20)}
    assert got == want
    same = [blocks.roots(t).where("path = 'same'").first().digest for t in (a, b)]
    assert same[0] == same[1]


def test_chain_names_what_changed_and_what_follows(spark):
    make = lambda rows: blocks.chain(spark.createDataFrame(rows, "stage int, name string, root string"))
    old = make([(1, "raw", "a"), (2, "pool", "b"), (3, "index", "c")])
    new = make([(1, "raw", "a"), (2, "pool", "B"), (3, "index", "c"), (4, "more", "d")])
    assert {r.name: r.fault for r in blocks.broken(old, new).collect()} == {"pool": "changed", "index": "stale", "more": "new"}
    assert blocks.broken(old, old).count() == 0 and make([]).count() == 0


def test_build_stops_before_it_publishes(spark, tmp_path):
    from quillspark.sources.builds import Build, Stage, StageFault, root_of_files

    source, folder, target = (f"file://{tmp_path}/{n}" for n in ("in", "work", "out"))
    spark.range(20).coalesce(1).write.parquet(source)
    stages = lambda bad: [Stage("a", lambda: spark.read.parquet(source)), Stage("b", lambda a: a.where("id > 4"), ["a"], str(bad), check=lambda t: t.where("id > 18") if bad else t.limit(0))]
    root = root_of_files(spark, source)
    Build(spark, folder, target, {"x": (source, root)}).run(stages(False))
    before = root_of_files(spark, target)
    with pytest.raises(StageFault, match="stage b"):
        Build(spark, folder, target, {"x": (source, root)}).run(stages(True))
    with pytest.raises(StageFault, match="release"):
        Build(spark, folder, target, {"x": (source, root)}).run(stages(False), final=lambda t: t["b"])
    with pytest.raises(StageFault, match="locked"):
        Build(spark, folder, target, {"x": (source, "0" * 64)}).run(stages(False))
    with pytest.raises(StageFault, match="missing"):
        Build(spark, folder, target, {"x": (source + "-none", None)}).run(stages(False))
    assert root_of_files(spark, target) == before and spark.read.parquet(f"{target}/b").count() == 15


# -- keyword rules ----------------------------------------------------------------------------------
def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "first", "second"),
    [
        ("What is the percentage change in revenue from 2018 to 2019?", "change", "percentage_change"), ("is cost greater than price", "comparison", "comparison"), ("the average of both", "table_aggregation", "average"),
        ("2018, 2019", "other", "multi_step"), ("in 2018 and 2018", "other", "other"), ("what share of total", "ratio", "ratio"), ("sum up", "aggregation", "aggregation"), ("it is the total.", "aggregation", "other"), (None, "other", "other"),
    ],
)
def test_families(spark, text, first, second):
    x = F.lit(text).cast("string")
    assert (one(spark, R.question_family(x)), one(spark, R.predicted_family(x))) == (first, second)


def test_other_rules(spark):
    assert one(spark, R.question_type(F.lit("How much is it"))) == "how_much" and one(spark, R.question_type(F.lit(" what"))) == "other"
    assert one(spark, R.roles(F.lit("revenue per share"))) == ["denominator", "monetary_metric", "numerator", "part", "per_unit", "share_metric", "whole"]
    assert one(spark, R.sanitize(F.lit(" In 2019 it paid $ 1,200.50 and 7,000  or 0 of 12 "))) == "In a reporting period it paid a monetary value and a numeric value or 0 of a numeric value"
    assert [tuple(h) for h in one(spark, R.leak_hits(F.lit("in 2019 $5 1")))] == [("four_digit_year", "2019"), ("currency_or_large_number", "$5"), ("standalone_number", "2019"), ("standalone_number", "5")]
    assert one(spark, R.plain_answer(F.lit("The 1,000 of (134) an 12% apples!"))) == "1000 of -134 0.12 apples"
    assert one(spark, R.number_text(F.lit("3 million"))) == "3000000" and one(spark, R.number_text(F.lit("1.5 billion"))) == "1500000000.0"
    assert one(spark, R.is_number(F.lit("3 million"))) and not one(spark, R.is_number(F.lit("3 dogs")))


# -- nested policies --------------------------------------------------------------------------------
def test_sparse_vectors_over_a_numbered_dictionary(spark):
    df = spark.createDataFrame([(1, {"b": 2.0, "zz": 1.0}), (2, {"a": 1.0, "b": None}), (3, None)], "id long, m map<string,double>")
    known = nested.dictionary(spark.createDataFrame([("c",), ("b",), ("a",), ("b",), (None,)], "name string"))
    assert {r.name: r["index"] for r in known.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.id: (r.indices, r["values"]) for r in nested.sparse(df, "id", "m", known).collect()} == {1: ([1], [2.0]), 2: ([0], [1.0]), 3: ([], [])}


def test_fits_reach_their_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(size=60) * 0.1
    w = nested.ridge(x, y)
    c = x - x.mean(0)
    assert np.allclose((c.T @ (y - x @ w[:-1] - w[-1])) - w[:-1], 0, atol=1e-8)
    wide = nested.ridge(np.hstack([x, np.zeros((60, 100))]), y)  # more features than rows: the same answer
    assert np.allclose(wide[:4], w[:4]) and np.allclose(wide[-1], w[-1])
    label = (x[:, 0] + x[:, 1] > 0).astype(int)
    v = nested.softmax(x, label, 2)[0]
    p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
    weight = 0.5 * 60 / (2 * np.bincount(label))[label]
    assert np.abs(x.T @ ((p - label) * weight) + v[:-1]).max() < 1e-2
    three = nested.softmax(x, np.digitize(x[:, 2], [-0.5, 0.5]), 3)
    assert three.shape == (3, 5) and (np.argmax(np.column_stack([x, np.ones(60)]) @ three.T, 1) == np.digitize(x[:, 2], [-0.5, 0.5])).mean() > 0.7


def test_nested_policy_learns_what_is_there(spark):
    """Where a feature tells which arm is right the policy finds it, though one feature set is noise; no record is chosen for by models that saw its group."""
    rows = []
    for i in range(240):
        helps = i % 3 == 0
        rows.append((i, i // 4, float(not helps), float(helps), 0.0, float(helps), 0.0, float(not helps), float(not helps), {"helps": float(helps)}, {"noise": float(i * 7 % 11)}))
    df = spark.createDataFrame(rows, "id long, grp long, p_both double, p_case double, p_none double, gain_case double, gain_none double, harm_case double, harm_none double, good map<string,double>, bad map<string,double>")
    run = nested.nested_policy(df, "id", "grp", ["none", "case"], "both", {"noise": "bad", "told": "good"}, outer=3, inner=2)
    got = run.choices.collect()
    assert sorted(r.id for r in got) == list(range(240))
    assert sum(r.value for r in got) >= 235 and sum(r.base_value for r in got) == 160
    table = run.table.toPandas()
    assert len(table) == 3 * (1 + 2 * (8 + 32 + 5)) and {r.set for r in run.selected.collect()} == {"told"}
    base = table[table.architecture == "always_base"]
    assert (base.mean_gain.abs() < 1e-12).all() and (base.coverage == 0).all()
    plan = nested.fold_plan(df, "grp", 3, 2).toPandas()
    assert (plan.groupby("grp").outer.nunique() == 1).all() and ((plan.g == -1) == (plan.outer == plan.f)).all()


def test_conservative_choice_prefers_the_base(spark):
    rows = [(0, 0, "always_base", None, None, 0.0, 0.0, 0.0), (0, 1, "flat_delta", 0.1, None, 0.02, 0.05, 0.4), (0, 2, "flat_delta", 0.2, None, 0.01, 0.0, 0.0), (1, 0, "always_base", None, None, 0.0, 0.0, 0.0), (1, 1, "gain_harm", 0.1, 2.0, 0.2, 0.05, 0.4), (1, 2, "gain_harm", 0.1, 3.0, 0.18, 0.05, 0.4)]
    t = spark.createDataFrame(rows, "f int, number int, architecture string, threshold double, lam double, mean_gain double, se_gain double, coverage double")
    assert {r.f: r.number for r in nested.conservative(t, "f").collect()} == {0: 0, 1: 2}


# -- alignments, resampling, accumulators -----------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 5])
def test_assignments_of_a_whole_batch(n):
    cost = np.random.default_rng(n).integers(0, 6, (40, n, n)).astype(float)
    want = [min(sum(c[p[j], j] for j in range(n)) for p in permutations(range(n))) for c in cost]
    assert matching.assign(cost).tolist() == want


def test_alignment_of_odd_sides(spark):
    df = spark.createDataFrame([(1, [["a"], ["b", "c"]], [["b", "c"]]), (2, [], []), (3, None, [["a"]]), (4, [], [["a"]]), (5, [[]], [[]]), (6, [["2", "x"]], [["1", "x"]])], "id int, a array<array<string>>, b array<array<string>>")
    assert {r.id: r.f1 for r in matching.aligned(df, "a", "b").collect()} == {1: 0.5, 2: 1.0, 3: None, 4: 0.0, 5: 1.0, 6: 0.5}
    assert matching.aligned(df, "a", "b", need_number=True).where("id = 6").first().f1 == 0.0


def test_mcnemar_of_small_and_large_counts(spark):
    from math import comb

    pairs = [(0, 0), (1, 0), (3, 9), (10, 10), (40, 61), (700, 812), (0, 30)]
    df = spark.createDataFrame([*pairs, (10**9, 10**9 + 100_000)], "b long, c long")
    got = {(r.b, r.c): r.p for r in df.select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()}
    for b, c in pairs:
        n = b + c
        want = min(1.0, 2 * sum(comb(n, i) for i in range(max(b, c), n + 1)) / 2**n)
        assert got[b, c] == pytest.approx(want, rel=1e-9)
    assert got[10**9, 10**9 + 100_000] == pytest.approx(0.02535, abs=2e-4)  # as the normal limit has it


def test_resampling_is_poisson_and_repeats(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("v"))
    a, b = (stats.resampled(d, "id", 400, 3, s=F.col("v"), n=F.lit(1)).toPandas().sort_values("rep").reset_index(drop=True) for d in (df.repartition(3), df.repartition(7)))
    assert np.allclose(a, b) and a.n[0] == 500 and a.s[0] == sum(i % 7 for i in range(500))
    n = a.n[1:]
    assert abs(n.mean() - 500) < 4 and abs(n.var() / 500 - 1) < 0.3
    r = stats.paired_bootstrap(df.select("id", "v", F.lit(0).alias("z")), "id", "v", "z", 2000, 5).first()
    se = np.std([i % 7 for i in range(500)]) / 500**0.5
    assert abs(r.low - (r.diff - 1.96 * se)) < 0.03 and abs(r.high - (r.diff + 1.96 * se)) < 0.03


def test_states_merge_in_any_order_and_count_once(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i), i % 3) for i in range(100)] + [(100, "c", None, 1), (101, "d", 5.0, None)]
    df = spark.createDataFrame(rows, "id int, k string, v double, w int")
    folder = f"file://{tmp_path}/states"
    for part in (1, 0, 2, 1):
        accumulators.commit(accumulators.states(df.where(F.col("id") % 3 == part), "v", "k", weight="w", quantiles=True), folder, f"p{part}")
    done = {r.k: r for r in accumulators.finished(accumulators.merged(accumulators.stored(spark, folder), "k"), "k").collect()}
    for k in "ab":
        own = [(v, w) for _, key, v, w in rows if key == k and v is not None]
        n = sum(w for _, w in own)
        assert done[k].n == n and done[k].mean == pytest.approx(sum(v * w for v, w in own) / n) and abs(done[k].median - 50) < 6
    assert (done["d"].n, done["d"].mean, "c" in done) == (0.0, 0.0, False)
    with pytest.raises(ValueError):
        accumulators.commit(accumulators.states(df, "v", "k"), folder, "a/b")


@pytest.mark.parametrize("exclude", [None, "same", "other"])
def test_blocks_of_queries_find_what_one_pass_finds(spark, monkeypatch, exclude):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)], None if i % 5 == 0 else f"g{i % 3}") for i in range(300)]
    v = spark.createDataFrame(rows, "id long, vector array<float>, grp string").repartition(4)
    q, src = v.where("id % 7 = 0").withColumnRenamed("id", "target_id"), v.withColumnRenamed("id", "source_id")
    got = []
    for most in (1 << 25, 1):
        monkeypatch.setattr(retrieval, "SENT_BYTES", most)
        monkeypatch.setattr(retrieval, "QUERIES", 10)
        monkeypatch.setattr(retrieval, "SOURCES", 40)
        got.append(sorted(map(tuple, retrieval.top_k(q, src, 3, exclude=exclude).select("target_id", "rank", "source_id", "score").collect())))
    assert got[0] == got[1] and len(got[0]) == 43 * 3


# -- guards on a stream -----------------------------------------------------------------------------
def test_pins_outlive_a_restart(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "key string, id long, fp string, at timestamp"
    logs, out, state, kept, kstate = (f"file://{tmp_path}/{n}" for n in ("logs", "out", "state", "kept", "kstate"))
    for rows in ([("a", 1, "v1", at(5)), ("a", 2, "v0", at(1)), ("b", 3, None, at(2))], [("a", 4, "v0", at(9)), ("a", 5, "v1", at(8)), ("b", 6, "x", at(9))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(logs)
        log = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(logs)
        guard.run_guarded(guard.guarded(log, "key", "id", "fp", "at"), out, state)
        guard.upsert(log, "key", "at", kept, kstate)
    got = {r.id: (r.pinned, r.accepted) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("v0", False), 2: ("v0", True), 3: (None, False), 4: ("v0", True), 5: ("v0", False), 6: ("x", True)}
    assert {r.key: r.id for r in guard.current(spark, kept).collect()} == {"a": 4, "b": 6}
    assert guard.current(spark, f"file://{tmp_path}/nothing") is None


def test_nested_ratings_without_tables_of_scores(spark, monkeypatch):
    """Ratings and choices of fits that every task holds are those of joined scores, and no table has a row for each score."""
    rng, rows, arms = np.random.default_rng(3), [], ["none", "case", "strategy"]
    for i in range(400):
        x, p = rng.normal(size=3), {a: float(rng.integers(0, 4)) / 3 for a in [*arms, "both"]}
        told = {"a": float(x[0]), "b": None if i % 9 == 0 else float(x[1]), f"rare{i % 50}": 1.0, "lead": 2 * p["case"] - 2 * p["both"] + float(x[2])}
        rows.append((i, None if i % 40 == 0 else i // 8, *p.values(), *(max(p[a] - p["both"], 0.0) for a in arms), *(max(p["both"] - p[a], 0.0) for a in arms), None if i % 17 == 0 else {k: told[k] for k in ("a", "b")}, told))
    names = [f"{k}_{a}" for k in ("p", "gain", "harm") for a in (*arms, *(("both",) if k == "p" else ()))]
    df = spark.createDataFrame(rows, "id long, grp long, " + ", ".join(f"{n} double" for n in names) + ", few map<string,double>, more map<string,double>")
    kept, sizes = nested._kept, []

    def counted(t):
        out = kept(t)
        sizes.append(out.count())
        return out

    def run():
        r = nested.nested_policy(df, "id", "grp", arms, "both", {"few": "few", "more": "more"}, outer=3, inner=2, prior=["strategy", "none", "case"], most=150)
        return r.table.toPandas().sort_values(["f", "number"]).reset_index(drop=True), r.choices.select("id", "outer", "chosen", "value", "base_value").toPandas().sort_values("id").reset_index(drop=True)

    monkeypatch.setattr(nested, "_kept", counted)
    monkeypatch.setattr(nested, "DENSE", 100, raising=False)
    table, choices = run()
    assert max(sizes) <= 1000, sizes
    monkeypatch.setattr(nested, "HELD", 0)
    table2, choices2 = run()
    assert max(sizes) > 1000
    pd.testing.assert_frame_equal(table, table2[table.columns], rtol=0, atol=1e-9)
    pd.testing.assert_frame_equal(choices, choices2, rtol=0, atol=1e-9)
    assert choices.chosen.nunique() > 1
