"""Algebra over arm outcomes: a long table (sample_id, arm, replicate, correct)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ARMS = ("none", "case", "strategy", "both")


def hit(c: Column | str = "correct") -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def wide(outcomes: DataFrame, arms: tuple[str, ...] = ARMS, by: tuple[str, ...] = ("sample_id", "replicate")) -> DataFrame:
    """One boolean column for each arm; a missing outcome counts as wrong. One shuffle, no pivot discovery pass."""
    return outcomes.groupBy(*by).agg(*(F.coalesce(F.bool_or(F.when(F.col("arm") == a, F.col("correct"))), F.lit(False)).alias(a) for a in arms))


def accuracy(outcomes: DataFrame, *by: str) -> DataFrame:
    """Count and mean of correct by arm and further keys."""
    return outcomes.groupBy("arm", *by).agg(F.count("*").alias("n"), F.avg(hit()).alias("accuracy"))


def fixed_and_oracle(outcomes: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """By replicate: best fixed arm (first in order wins ties), its accuracy, the oracle's, and the gap."""
    w = wide(outcomes, arms).groupBy("replicate").agg(*(F.avg(hit(a)).alias(a) for a in arms), F.avg(F.greatest(*(hit(a) for a in arms))).alias("oracle"))
    best = F.greatest(*(F.col(a) for a in arms))
    name = F.coalesce(*(F.when(F.col(a) == best, F.lit(a)) for a in arms))
    return w.select("replicate", name.alias("best_arm"), best.alias("best_fixed"), "oracle", (F.col("oracle") - best).alias("gap"))


def expected(outcomes: DataFrame) -> DataFrame:
    """Best fixed and oracle when an arm's value for a sample is its mean over replicates."""
    p = outcomes.groupBy("sample_id", "arm").agg(F.avg(hit()).alias("p"))
    fixed = p.groupBy("arm").agg(F.avg("p").alias("p")).agg(F.max("p").alias("best_fixed"))
    top = p.groupBy("sample_id").agg(F.max("p").alias("p")).agg(F.avg("p").alias("oracle"))
    return fixed.crossJoin(top).withColumn("gap", F.col("oracle") - F.col("best_fixed"))  # one row each


def contingency(outcomes: DataFrame, a: str, b: str) -> DataFrame:
    w = wide(outcomes, (a, b))
    x, y = F.col(a), F.col(b)
    return w.groupBy("replicate").agg(F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def interference(outcomes: DataFrame) -> DataFrame:
    w, c, s, b = wide(outcomes), F.col("case"), F.col("strategy"), F.col("both")
    return w.groupBy("replicate").agg(F.count_if(~b & (c | s)).alias("both_worse"), F.count_if(b & ~c & ~s).alias("both_better"), F.count_if(b == (c | s)).alias("both_same"))


def patterns(outcomes: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """How often each set of right arms occurs."""
    w = wide(outcomes, arms)
    p = F.array_join(F.array_compact(F.array(*(F.when(F.col(a), F.lit(a)) for a in arms))), "+")
    return w.groupBy("replicate", F.when(p == "", "(none right)").otherwise(p).alias("pattern")).agg(F.count("*").alias("n"))


def exclusive(outcomes: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Samples that exactly one arm gets right, by arm."""
    w = wide(outcomes, arms)
    right = F.filter(F.array(*(F.when(F.col(a), F.lit(a)) for a in arms)), lambda v: v.isNotNull())
    return w.where(F.size(right) == 1).groupBy("replicate", F.element_at(right, 1).alias("arm")).agg(F.count("*").alias("rescues"), F.min("sample_id").alias("first_id"))


def transitions(outcomes: DataFrame, base: str = "none", arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Rescue, harm, both right or both wrong of each arm against the base."""
    others = [a for a in arms if a != base]
    w = wide(outcomes, arms).unpivot(["sample_id", "replicate", base], others, "arm", "right")
    kind = F.when(F.col(base) & F.col("right"), "both_right").when(~F.col(base) & ~F.col("right"), "both_wrong").when(F.col("right"), "rescue").otherwise("harm")
    return w.groupBy("arm", kind.alias("transition")).agg(F.count("*").alias("n"))


def agreement(outcomes: DataFrame) -> DataFrame:
    """Share of samples on which two replicates of an arm agree, for each pair of replicates."""
    # sorted, as Spark's guess of an exploded table's size is that before the explode, and it would be sent whole through the driver
    a, b = outcomes.alias("a"), outcomes.hint("merge").alias("b")
    j = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.arm") == F.col("b.arm")) & (F.col("a.replicate") < F.col("b.replicate")))
    return j.groupBy(F.col("a.arm").alias("arm"), F.col("a.replicate").alias("rep_a"), F.col("b.replicate").alias("rep_b")).agg(F.avg((F.col("a.correct") == F.col("b.correct")).cast("double")).alias("agreement"))


def flips(outcomes: DataFrame) -> DataFrame:
    """Share of samples whose outcome changes over the replicates, by arm."""
    s = outcomes.groupBy("arm", "sample_id").agg((F.min("correct") != F.max("correct")).alias("flips"))
    return s.groupBy("arm").agg(F.count("*").alias("n"), F.avg(hit("flips")).alias("flip_rate"))


def stability(outcomes: DataFrame, a: str, b: str) -> DataFrame:
    """In how many replicates ``a`` beats ``b``: histogram over samples."""
    w = wide(outcomes, (a, b)).groupBy("sample_id").agg(F.count_if(F.col(a) & ~F.col(b)).alias("wins"))
    return w.groupBy("wins").agg(F.count("*").alias("samples"))


def marginal(outcomes: DataFrame, base: str = "both", arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Gain, harm, delta and net utility of leaving the base for each other arm, by sample."""
    others = [a for a in arms if a != base]
    w = wide(outcomes, arms).unpivot(["sample_id", "replicate", base], others, "arm", "right")
    r, b = F.col("right"), F.col(base)
    g = w.groupBy("sample_id", "arm").agg(F.avg(hit(r & ~b)).alias("gain"), F.avg(hit(~r & b)).alias("harm"), (F.avg(hit(r)) - F.avg(hit(b))).alias("delta"), F.count_if(r & ~b).alias("events"))
    return g.withColumn("net", F.col("gain") - F.col("harm"))


def support(outcomes: DataFrame, base: str = "both") -> DataFrame:
    """By arm: samples with at least one, two and three gain events."""
    return marginal(outcomes, base).groupBy("arm").agg(*(F.count_if(F.col("events") >= k).alias(f"at_least_{k}") for k in (1, 2, 3)))


def transfer(outcomes: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Leave one replicate out: each sample's best arm on the others (ties: the arm better overall, then by name), scored on the one left out."""
    # scores on the other replicates are sums over all less the one left out, so nothing is copied once a fold;
    # a sample's rows are dealt to one task once, and the picked row holds what it is scored by
    sums = (F.sum(hit()).alias("h"), F.count("correct").alias("c"), F.count("*").alias("n"))
    own = outcomes.where("sample_id is not null and arm is not null and replicate is not null").repartition("sample_id").groupBy("sample_id", "arm", "replicate").agg(*sums)

    def others(x: DataFrame, name: str, *by: str) -> DataFrame:
        every = W.partitionBy(*by)
        x = x.withColumns({f"all_{k}": F.sum(k).over(every) for k in "hcn"}).where("all_n > n")
        return x.withColumn(name, F.try_divide(F.col("all_h") - F.coalesce("h", F.lit(0.0)), F.col("all_c") - F.col("c"))).drop("all_h", "all_c", "all_n")

    overall = others(outcomes.groupBy("arm", "replicate").agg(*sums), "prior", "arm")
    place = F.row_number().over(W.partitionBy("replicate").orderBy(F.desc("prior"), "arm"))
    overall = overall.select("arm", "replicate", (-place).alias("place"))
    per = others(own, "score", "sample_id", "arm").join(F.broadcast(overall), ["arm", "replicate"])  # a row an arm and replicate
    best = per.groupBy("sample_id", "replicate").agg(F.max(F.struct("score", "place", "h", "c", "n")).alias("b"))
    return best.groupBy("replicate").agg(F.sum("b.n").alias("n"), F.try_divide(F.sum("b.h"), F.sum("b.c")).alias("transfer_accuracy"))


def policy(outcomes: DataFrame, choices: DataFrame, base: str = "both") -> DataFrame:
    """A policy (sample_id, arm) against always the base: accuracy, gain, recovery, coverage, precision, harmful rate."""
    w = wide(outcomes).join(choices.withColumnRenamed("arm", "choice"), "sample_id", "left").withColumn("choice", F.coalesce("choice", F.lit(base)))
    chosen = F.coalesce(*(F.when(F.col("choice") == a, F.col(a)) for a in ARMS))
    dev, b = F.col("choice") != base, F.col(base)
    g = w.groupBy("replicate").agg(F.avg(hit(chosen)).alias("accuracy"), F.avg(hit(b)).alias("base"), F.avg(F.greatest(*(hit(a) for a in ARMS))).alias("oracle"), F.avg(hit(dev)).alias("coverage"), F.count_if(dev & chosen & ~b).alias("beneficial"), F.count_if(dev & ~chosen & b).alias("harmful"), F.count_if(dev).alias("deviated"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return g.select("replicate", "accuracy", (F.col("accuracy") - F.col("base")).alias("gain"), ratio(F.col("accuracy") - F.col("base"), F.col("oracle") - F.col("base")).alias("recovery"), "coverage", ratio(F.col("beneficial"), F.col("deviated")).alias("precision"), ratio(F.col("harmful"), F.col("deviated")).alias("harmful_rate"))


def pareto(outcomes: DataFrame, costs: DataFrame) -> DataFrame:
    """Mean cost and accuracy of each arm, and whether no arm is both cheaper and better. costs: (sample_id, arm, tokens)."""
    # sorted: costs that come from an explode are more than Spark guesses (as in ``agreement``)
    g = outcomes.join(costs.hint("merge"), ["sample_id", "arm"]).groupBy("arm").agg(F.avg("tokens").alias("tokens"), F.avg(hit()).alias("accuracy"))
    best = F.max("accuracy").over(W.orderBy("tokens", F.desc("accuracy")).rowsBetween(W.unboundedPreceding, -1))  # one row an arm
    return g.select("arm", "tokens", "accuracy", F.coalesce(F.col("accuracy") > best, F.lit(True)).alias("on_front"))


def monotone(levels: DataFrame, level: str, value: str) -> DataFrame:
    """Whether the value never rises from level to level."""
    d = levels.withColumn("before", F.lag(value).over(W.orderBy(level)))
    return d.agg(F.coalesce(F.bool_and(F.col(value) <= F.col("before")), F.lit(True)).alias("never_rises"), F.count("*").alias("levels"))


def same_runtime(records: DataFrame, *keys: str) -> DataFrame:
    """Distinct values of each runtime key, sorted."""
    return records.agg(*(F.array_sort(F.collect_set(k)).alias(k) for k in keys))


def funnel(results: DataFrame, *by: str) -> DataFrame:
    """How many answers of each arm have a program, parse, execute and are right; results has status and correct."""
    past = {"has_program": ("no_program",), "parsed": ("no_program", "operator_only", "parse_fail"), "executed": ("no_program", "operator_only", "parse_fail", "exec_fail")}
    return results.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(~F.col("status").isin(*lost)).alias(name) for name, lost in past.items()), F.count_if("correct").alias("correct"))


def failures(results: DataFrame, category: str, *by: str) -> DataFrame:
    """Counts by category over wrong answers only."""
    return results.where(~F.coalesce(F.col("correct"), F.lit(False))).groupBy(*by, category).agg(F.count("*").alias("n"))


def running_mean(updates: DataFrame, value: str, n: str, *by: str) -> DataFrame:
    """Mean of updates (value, n) as an accumulator keeps it: sums of value times n and of n, which merge in any order."""
    return updates.groupBy(*by).agg(F.sum(F.col(value) * F.col(n)).alias("total"), F.sum(n).alias("n")).withColumn("mean", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)))


def tallies(scored: DataFrame, value: str, *keys: str) -> DataFrame:
    """(kind, key, n, total, mean): over all rows and for each value of each key, in one pass over partial sums."""
    kinds = F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")), *(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("none")).alias("key")) for k in keys)))
    return scored.select(F.col(value).cast("double").alias("v"), kinds.alias("at")).groupBy("at.kind", "at.key").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))


def family_audit(cases: DataFrame, steps: str, key: str, failed: str, families: dict[str, Column]) -> DataFrame:
    """(family, cases, steps, failures) for named tests of a step ``s``: distinct cases with such a step, such steps, distinct failed cases."""
    s = cases.select(key, failed, F.explode(steps).alias("s"))
    kind = F.explode(F.array_compact(F.array(*(F.when(test, name) for name, test in families.items()))))
    return s.select(key, failed, kind.alias("family")).groupBy("family").agg(F.count_distinct(key).alias("cases"), F.count("*").alias("steps"), F.count_distinct(F.when(F.col(failed), F.col(key))).alias("failures"))


def family_gains(outcomes: DataFrame, family: str, base: str = "none", arms: tuple[str, ...] = ARMS) -> DataFrame:
    """By family: what each arm gains over the base, and how often only case, only strategy or neither is right."""
    w = wide(outcomes, arms, ("sample_id", "replicate", family))
    case, strategy = F.col("case"), F.col("strategy")
    return w.groupBy(family).agg(F.count("*").alias("n"), *((F.avg(hit(a)) - F.avg(hit(base))).alias(f"gain_{a}") for a in arms if a != base), F.count_if(case & ~strategy).alias("case_only"), F.count_if(strategy & ~case).alias("strategy_only"), F.count_if(~case & ~strategy).alias("both_wrong"))


def drill_down(outcomes: DataFrame, base: str = "none", most: int = 3, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """(arm, kind, n, examples): rescues, harms and disagreements with the base, with the first few samples of each."""
    w = wide(outcomes, arms, ("sample_id",))
    each = w.select("sample_id", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.when(F.col(a) & ~F.col(base), "rescue").when(~F.col(a) & F.col(base), "harm").when(F.col(a), "both_right").otherwise("both_wrong").alias("kind")) for a in arms if a != base))).alias("o")).select("sample_id", "o.*")
    first = W.partitionBy("arm", "kind").orderBy("sample_id")
    few = each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).groupBy("arm", "kind").agg(F.sort_array(F.collect_list("sample_id")).alias("examples"))  # most rows a group
    return each.groupBy("arm", "kind").agg(F.count("*").alias("n")).join(few, ["arm", "kind"])


def exclusive_ids(outcomes: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """(arm, replicate, sample_id) that this arm alone gets right."""
    w = wide(outcomes, arms)
    n = sum((F.col(a).cast("int") for a in arms), F.lit(0))
    return w.where(n == 1).select(F.coalesce(*(F.when(F.col(a), F.lit(a)) for a in arms)).alias("arm"), "replicate", "sample_id")


def largest_share(events: DataFrame, group: str) -> DataFrame:
    """(events, groups, top_share): how much of all events the largest group holds."""
    g = events.groupBy(group).agg(F.count("*").alias("c"))
    return g.agg(F.sum("c").alias("events"), F.count("*").alias("groups"), (F.max("c") / F.sum("c")).alias("top_share"))


def stable_marginals(outcomes: DataFrame, base: str = "both", arms: tuple[str, ...] = ARMS) -> DataFrame:
    """By arm: net gain over the base in each replicate, whether it has one sign throughout, and the least and greatest."""
    w = wide(outcomes, arms)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), (hit(a) - hit(base)).alias("d")) for a in arms if a != base))).alias("e")
    net = w.select("replicate", each).groupBy("e.arm", "replicate").agg(F.avg("e.d").alias("net"))
    return net.groupBy("arm").agg(F.min("net").alias("least"), F.max("net").alias("greatest"), ((F.min("net") > 0) | (F.max("net") < 0)).alias("stable"))


def disagreement(outcomes: DataFrame) -> DataFrame:
    """(arm, any_change, pairwise): share of samples that change at all over the runs, and of pairs of runs that disagree."""
    s = outcomes.groupBy("arm", "sample_id").agg(F.count("*").alias("r"), F.count_if("correct").alias("m"))
    pairs = F.col("r") * (F.col("r") - 1) / 2
    return s.groupBy("arm").agg(F.avg(((F.col("m") > 0) & (F.col("m") < F.col("r"))).cast("double")).alias("any_change"), F.try_divide(F.sum(F.col("m") * (F.col("r") - F.col("m"))), F.sum(pairs)).alias("pairwise"))


def graded_change(before: Column, after: Column, near_before: Column, near_after: Column) -> Column:
    """repaired, broken, improved (wrong, but nearer than before), worse (wrong and farther), unchanged_right or unchanged_wrong."""
    return F.when(~before & after, "repaired").when(before & ~after, "broken").when(before, "unchanged_right").when(near_after < near_before, "improved").when(near_after > near_before, "worse").otherwise("unchanged_wrong")
