"""Alignment features of a question and what was retrieved for it: about a hundred sparse numbers a question, by joins.

What a question, case or strategy says is read once from its own row; hits join those readings and a
question's hits (a top-k) are one row when features are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import programs as P
from ..functions import rules as R

# Words that give a strategy further families, and the step count that a role stands for.
STRATEGY_WORDS = [
    ("percentage_change", ["change", "growth", "increase", "decrease", "cumulative return"]),
    ("average", ["average", "mean"]),
    ("aggregation", ["sum", "total", "aggregate"]),
    ("ratio", ["part", "whole", "share", "portion", "ratio"]),
]
ROLES_A_STEP, HIGH_OVERLAP, LOW_OVERLAP, MOST_MISMATCH = 2.5, 0.25, 0.2, 0.75


def strategy_families(programs: Column, text: Column) -> Column:
    """Families of a strategy's programs (arrays of operators) and of its words, sorted, each once; ``other`` if there are none."""
    of_programs = F.transform(F.coalesce(programs, F.array().cast("array<array<string>>")), lambda ops: P.aligned_family(ops))
    none = F.array().cast("array<string>")
    of_words = [F.when(R.within(text, words), F.array(F.lit(name))).otherwise(none) for name, words in STRATEGY_WORDS]
    got = F.sort_array(F.array_distinct(F.concat(of_programs, *of_words)))
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit("other")))


def read_questions(df: DataFrame, key: str, text: str) -> DataFrame:
    q = F.col(text)
    return df.select(F.col(key).alias("id"), R.predicted_family(q).alias("family"), R.roles(q).alias("roles"), F.least(F.lit(2), F.size(R.years(q))).alias("years"), R.scale_profile(q, F.lit(None), F.lit("")).alias("scale"))


def read_cases(df: DataFrame, key: str, text: str, answer: str, ops: str, steps: str) -> DataFrame:
    t = F.col(text)
    return df.select(
        F.col(key).alias("source"), F.array(P.aligned_family(F.coalesce(F.col(ops), F.array().cast("array<string>")))).alias("families"), F.array(F.array_join(F.coalesce(F.col(ops), F.array().cast("array<string>")), ">")).alias("structs"),
        R.roles(t).alias("s_roles"), F.least(F.lit(2), F.size(R.years(t))).alias("s_years"), R.scale_profile(t, F.col(answer), F.lit("")).alias("s_scale"), F.coalesce(F.col(steps).cast("double"), F.lit(0.0)).alias("steps"),
    )


def read_strategies(df: DataFrame, key: str, text: str, programs: str, scale: str) -> DataFrame:
    t = F.col(text)
    structs = F.transform(F.coalesce(F.col(programs), F.array().cast("array<array<string>>")), lambda ops: F.array_join(ops, ">"))
    return df.select(
        F.col(key).alias("source"), strategy_families(F.col(programs), t).alias("families"), structs.alias("structs"), R.roles(t).alias("s_roles"), F.lit(0).alias("s_years"), R.scale_profile(t, F.lit(None), F.col(scale)).alias("s_scale"), F.lit(0.0).alias("steps"),
    )


def shares(x: Column) -> Column:
    """The share of each distinct entry of an array."""
    return F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)) / F.size(x))


def mode_share(x: Column) -> Column:
    return F.coalesce(F.array_max(shares(x)), F.lit(0.0))


def entropy(x: Column) -> Column:
    """Natural entropy of the entries, 1e-12 inside the logarithm; 0 for an empty array."""
    return -F.aggregate(shares(x), F.lit(0.0), lambda acc, p: acc + p * F.log(p + 1e-12)) + F.lit(0.0)


def mean(x: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), F.size(x)), F.lit(0.0))


def spread(x: Column) -> Column:
    """Population standard deviation; 0 for an empty array."""
    return A.let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def _double(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def alignment_features(questions: DataFrame, cases: DataFrame, strategies: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, features map): what ``read_questions``, ``read_cases`` and ``read_strategies`` made of each side, over hits (id, kind, source, rank, score), kind ``case`` or ``strategy``.

    A hit whose source is unknown is left out. A question without hits has the features of the question
    and zeros. The score of the first hit of each kind weighs in.
    """
    q = questions.select("id", "family", "roles", "years", "scale")
    own = {}
    for kind, sources in (("case", cases), ("strategy", strategies)):
        h = hits.where(F.col("kind") == kind).join(sources, "source").join(q, "id")
        percent, word = F.col("scale.asks_or_outputs_percent") != F.col("s_scale.asks_or_outputs_percent"), F.col("scale.has_scale_word") & ~F.col("s_scale.has_scale_word")
        one = F.struct(
            "rank", "source", "score", "families", "structs", "steps", A.jaccard(F.col("roles"), F.col("s_roles")).alias("overlap"), (F.col("years") == F.col("s_years")).cast("double").alias("same_years"),
            (percent | word).cast("double").alias("mismatch"), F.col("s_scale.fraction_convention").alias("fraction"),
        )
        own[kind] = h.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias(kind))  # a question's top-k
    x = q.join(own["case"], "id", "left").join(own["strategy"], "id", "left")
    x = x.select("id", "family", "roles", "scale", *(F.filter(F.coalesce(F.col(k), F.array().cast(own[k].schema[k].dataType)), lambda h: h["source"].isNotNull()).alias(k) for k in ("case", "strategy")))
    take = lambda k, f: F.transform(k, lambda h: h[f])
    lists = {f"{k}_{f}": take(k, f) for k in ("case", "strategy") for f in ("overlap", "mismatch", "fraction", "score")} | {f"case_{f}": take("case", f) for f in ("steps", "same_years")}
    lists |= {f"{k}_{f}": F.flatten(take(k, f)) for k in ("case", "strategy") for f in ("families", "structs")}
    x = x.select("id", "family", "roles", "scale", *(c.alias(n) for n, c in lists.items()))
    x = x.select("*", *(F.transform(f"{k}_families", lambda f: P.compatible(F.col("family"), f).cast("double")).alias(f"{k}_agree") for k in ("case", "strategy")))
    first = lambda c, default=0.0: F.coalesce(F.get(c, F.lit(0)), F.lit(default))
    any_of = lambda c: F.exists(c, lambda v: v > 0)
    top = {k: first(f"{k}_families", "none") for k in ("case", "strategy")}
    ratio_like, change_like, scale_like = (F.col("family").isin(*f) for f in (("ratio", "average"), ("percentage_change", "difference"), ("unit_scaling", "multiplication")))
    alone = lambda k: (F.size(f"{k}_families") > 1) & (F.size(F.filter(f"{k}_families", lambda f: f == top[k])) == 1)
    polluted = lambda k: F.col("scale.asks_or_outputs_percent") & first(f"{k}_fraction", False)
    features = {
        "pred_family_is_ratio_like": _double(ratio_like), "pred_family_is_change_like": _double(change_like), "pred_family_is_scale_like": _double(scale_like), "query_role_count": F.when(F.array_contains("roles", "count"), 1.0).otherwise(F.size("roles").cast("double")),
        "case_pred_family_top1_agree": first("case_agree"), "case_pred_family_any_agree": _double(any_of("case_agree")), "case_pred_family_agree_ratio": mean(F.col("case_agree")),
        "strategy_pred_family_any_agree": _double(any_of("strategy_agree")), "strategy_pred_family_agree_ratio": mean(F.col("strategy_agree")),
        "case_strategy_pred_family_both_agree": _double(any_of("case_agree") & any_of("strategy_agree")), "case_strategy_family_disagreement": _double(top["case"] != top["strategy"]),
        "case_role_overlap_top1": first("case_overlap"), "case_role_overlap_mean": mean(F.col("case_overlap")), "strategy_role_overlap_mean": mean(F.col("strategy_overlap")),
        "case_year_compat_top1": first("case_same_years"), "case_year_compat_mean": mean(F.col("case_same_years")), "case_symbolic_compat_top1": first("case_agree"), "case_symbolic_compat_mean": mean(F.col("case_agree")),
        "case_step_distance_top1": F.abs(first("case_steps") - F.greatest(F.lit(1.0), F.size("roles") / F.lit(ROLES_A_STEP))), "case_step_entropy_proxy": spread(F.col("case_steps")),
        **{f"{k}_{n}_mode_share": mode_share(F.col(f"{k}_{c}")) for k in ("case", "strategy") for n, c in (("struct", "structs"), ("family", "families"))},
        **{f"{k}_{n}_entropy_31": entropy(F.col(f"{k}_{c}")) for k in ("case", "strategy") for n, c in (("struct", "structs"), ("family", "families"))},
        **{f"query_scale_{n}": _double(F.col(f"scale.{n}")) for n in ("asks_or_outputs_percent", "fraction_convention", "raw_number_convention", "has_million", "has_billion", "has_thousand", "has_basis_points", "has_scale_word")},
        "case_scale_mismatch_top1": first("case_mismatch"), "case_scale_mismatch_mean": mean(F.col("case_mismatch")), "strategy_scale_mismatch_mean": mean(F.col("strategy_mismatch")),
        "case_strategy_scale_disagreement": _double(F.get("case_fraction", F.lit(0)) != F.get("strategy_fraction", F.lit(0))),
        **{f"scale_pollution_risk_{k}_fraction_for_percent_query": _double(polluted(k)) for k in ("case", "strategy")},
        "case_top_conflict_with_rest": _double(alone("case")), "strategy_top_conflict_with_rest": _double(alone("strategy")),
    }
    f = features
    features |= {
        "case_score_x_pred_family_agree": first("case_score") * f["case_pred_family_top1_agree"], "strategy_score_x_pred_family_agree": first("strategy_score") * f["strategy_pred_family_any_agree"],
        "case_score_x_role_overlap": first("case_score") * f["case_role_overlap_top1"],
        "retrieval_alignment_high_conf": _double(any_of("case_agree") & any_of("strategy_agree") & (f["case_role_overlap_mean"] >= HIGH_OVERLAP) & (f["case_scale_mismatch_mean"] < MOST_MISMATCH)),
        "retrieval_alignment_low_conf": _double(~any_of("case_agree") & ~any_of("strategy_agree") & (f["case_role_overlap_mean"] < LOW_OVERLAP)),
    }
    named = [F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in features.items()]
    hot = lambda prefix, v: F.struct(F.concat(F.lit(prefix), v).alias("name"), F.lit(1.0).alias("value"))
    one_hot = F.array(hot("pred_family_", F.col("family")), hot("case_top_pred_family_", top["case"]), hot("strategy_top_pred_family_", top["strategy"]))
    role_entries = F.transform(F.array_remove("roles", "count"), lambda r: hot("query_role_", r))  # its name is that of the number of roles
    return x.select("id", F.map_from_entries(reduce(F.concat, [F.array(*named), one_hot, role_entries])).alias("features"))
