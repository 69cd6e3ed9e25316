"""Golden answers and alignments."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import derivations as D
from quillspark.operators import abstractions, metrics, selectors, tables


@pytest.mark.parametrize(
    ("gold", "gs", "kind", "pred", "scale", "want"),
    [
        (["0"], "percent", "arithmetic", ["0"], "percent", (1, 1, 1)),
        (["1000"], "", "arithmetic", ["1,000"], "", (1, 1, 1)),
        (["4.6"], "percent", "arithmetic", ["0.046"], "", (1, 1, 0)),
        (["4.6"], "percent", "arithmetic", ["4.6"], "", (0, 0, 0)),
        (["2018", "2019"], "", "multi-span", ["2019", "2018"], "", (1, 1, 1)),
        (["a"], "", "span", [], "", (0, 0, 1)),
    ],
)
def test_golden_answers(gold, gs, kind, pred, scale, want):
    assert metrics.qa_metrics(gold, gs, kind, pred, scale) == want


def test_alignment_is_the_best_one():
    r = random.Random(0)
    for _ in range(60):
        a, b = ([{r.choice("abcde") for _ in range(r.randint(1, 3))} for _ in range(r.randint(0, 4))] for _ in range(2))
        n = max(len(a), len(b))
        f1 = lambda i, j: 2 * len(a[i] & b[j]) / (len(a[i]) + len(b[j])) if i < len(a) and j < len(b) else 0.0  # noqa: B023, E731
        best = max((sum(f1(i, j) for i, j in enumerate(p)) / n for p in itertools.permutations(range(n))), default=1.0) if n else 1.0
        assert metrics.align(a, b) == round(best, 2)


def test_group_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate("aaaabbbccd")], "i long, g string")
    f = {r.g: r.fold for r in selectors.group_folds(df, "g", 3).collect()}
    assert f == {"a": 0, "b": 1, "c": 2, "d": 2}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_deal_is_the_greedy_deal(k):
    r = random.Random(k)
    for _ in range(200):
        sizes = sorted((r.choice([1, 1, 1, 2, 3, 7, 50, 211]) for _ in range(r.randint(1, 120))), reverse=True)
        load, want = [0] * k, []
        for n in sizes:
            want.append(min(range(k), key=lambda i: (load[i], i)))
            load[want[-1]] += n
        got = []
        for n, spans in selectors.deal([(n, sizes.count(n)) for n in set(sizes)], k):
            for q in range(sizes.count(n)):
                first, folds = [s for s in spans if s[0] <= q][-1]
                got.append(folds[(q - first) % len(folds)])
        assert got == want


@pytest.mark.parametrize("bin_groups", [50_000, 1_000])
def test_group_folds_are_greedy_for_many_groups(spark, monkeypatch, bin_groups):
    """12,000 groups, one of them hot and one null."""
    monkeypatch.setattr(selectors, "BIN_GROUPS", bin_groups)
    n = {None: 4, **{g: 3000 if g == 77 else 1 + g % 3 for g in range(11_999)}}
    df = spark.createDataFrame(list(n.items()), "g long, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    load, want = [0] * 3, {}
    for g in sorted(n, key=lambda g: (-n[g], g is not None, g or 0)):
        want[g] = min(range(3), key=lambda i: (load[i], i))
        load[want[g]] += n[g]
    got = selectors.group_folds(df, "g", 3).collect()
    assert {r.g: r.fold for r in got} == want and len(got) == len(n)


def test_cross_validated_keeps_every_row(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7, {"a": float(i)}, i > 20) for i in range(40)], "i long, g long, f map<string,double>, y boolean")
    got = selectors.cross_validated(df, "f", "y", "g")
    assert sorted(r.i for r in got.collect()) == list(range(40)) and got.columns == ["g", "i", "f", "y", "fold", "p"]


def test_one_class_predicts_itself(spark):
    df = spark.createDataFrame([(1, {"a": 1.0}, True)], "i long, f map<string,double>, y boolean")
    assert selectors.fit_predict(df, df, "f", "y").first().p == 1.0
    both = spark.createDataFrame([(i, {"a": float(i)}, i > 5) for i in range(12)], "i long, f map<string,double>, y boolean")
    p = {r.i: r.p for r in selectors.fit_predict(both, both, "f", "y").collect()}
    assert p[0] < 0.5 < p[11]


def test_rare_features_stay_in_a_wide_vocabulary(spark, monkeypatch):
    """The label hangs on the rarest feature; test rows have one that training rows lack."""
    df = spark.createDataFrame([(i, {f"c{i % 3}": 1.0, f"d{i % 2}": 1.0} | ({"rare": 1.0} if i % 4 == 0 else {}), i % 4 == 0) for i in range(24)], "i long, f map<string,double>, y boolean")
    test = df.withColumn("f", F.map_concat("f", F.create_map(F.lit("new"), F.lit(9.0))))
    want = {r.i: r.p for r in selectors.fit_predict(df, test, "f", "y").collect()}
    monkeypatch.setattr(selectors, "VOCABULARY", 3)
    got = {r.i: r.p for r in selectors.fit_predict(df, test, "f", "y").collect()}
    assert len(selectors.vocabulary(df, "f")) == 6
    assert all(abs(got[i] - want[i]) < 1e-6 and (got[i] > 0.5) == (i % 4 == 0) for i in want)


def test_derivation_edges(spark):
    r = spark.range(1).select(D.tokens(F.lit("(-5 + 3)")).alias("a"), D.tokens(F.lit("")).alias("b"), abstractions.degenerate(F.lit("x")).alias("c")).first()
    assert (r.a, r.b, r.c) == (["(", "O1", "+", "O2", ")"], [], True)


def test_sampling_of_empty_tables(spark):
    e = spark.createDataFrame([], "k long, g string, v double")
    assert tables.terciles(e, "v", "k").count() == 0
    assert tables.corruption_levels(e, "k", [0.5], "t").count() == 0
    assert tables.quota_sample(e, "g", "k", {"a": 2}, "t").count() == 0
