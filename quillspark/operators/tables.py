"""Ingestion, grouping, ranking, sampling and set operators over ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# -- ingestion -------------------------------------------------------------------------------------
def explode_questions(contexts: DataFrame, questions: str, *parent: str) -> DataFrame:
    """One row a nested question, parent columns repeated, with its position."""
    return contexts.select(*parent, F.posexplode(questions).alias("position", "q")).select(*parent, "position", "q.*")


def with_gold(questions: DataFrame, answer: str) -> DataFrame:
    return questions.where(F.col(answer).isNotNull())


def table_facts(docs: DataFrame, table: str, *keys: str) -> DataFrame:
    """(keys, row_idx, col_idx, entity, column, value) of the cells of text tables; empty and dot cells go, a missing header is col_<j>."""
    r = docs.select(*keys, F.get(table, F.lit(0)).alias("head"), F.posexplode(F.slice(F.col(table), 2, F.greatest(F.size(table) - 1, F.lit(0)))).alias("row_idx", "cells"))
    c = r.select(*keys, "row_idx", "head", F.get("cells", F.lit(0)).alias("entity"), F.posexplode("cells").alias("col_idx", "value")).where("col_idx > 0")
    name = F.get("head", F.col("col_idx"))
    return c.where(~F.trim("value").isin("", ".")).select(*keys, "row_idx", "col_idx", "entity", F.when(F.trim(name) != "", name).otherwise(F.concat(F.lit("col_"), F.col("col_idx"))).alias("column"), "value")


def prefixed_facts(pre: Column, rows: Column, post: Column) -> Column:
    """Facts of a document: PRE, TABLE and POST lines in order."""
    mark = lambda p, a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.concat(F.lit(p), x))
    return F.concat(mark("PRE: ", pre), mark("TABLE: ", rows), mark("POST: ", post))


def keep_children(contexts: DataFrame, children: str, test) -> DataFrame:
    """Nested children that pass; parents without any go."""
    return contexts.withColumn(children, F.filter(children, test)).where(F.size(children) > 0)


# -- grouping --------------------------------------------------------------------------------------
def most_common(df: DataFrame, key: str, position: str, n: int | None = None) -> DataFrame:
    """Counts by key, most first, ties by first position."""
    g = df.groupBy(key).agg(F.count("*").alias("count"), F.min(position).alias("first_at")).orderBy(F.desc("count"), "first_at")
    return g.limit(n) if n else g


def cumulative_share(counts: DataFrame, key: str, count: str = "count") -> DataFrame:
    """Share of the total covered by the keys up to each; one row a key goes through the window."""
    w = W.orderBy(F.desc(count), key).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc(count), key))).withColumn("share", F.sum(count).over(w) / F.sum(count).over(W.partitionBy()))


def cumulative(counts: DataFrame, value: str, n: str, *by: str, cuts: int = 64) -> DataFrame:
    """counts (by, value, n) with ``before``: the sum of n over the smaller values of the group.

    Values are cut into ranges at approximate quantiles, so a group is ordered in many tasks and no task
    holds more than a range; the ranges only place work.
    """
    at = counts.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [k / cuts for k in range(1, cuts)], 0.002)
    part = F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(at)))), lambda x: x <= F.col(value).cast("double"))) if at else F.lit(0)
    c = counts.withColumn("_part", part)
    before = lambda w: F.coalesce(F.sum(F.col("_n")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = c.groupBy(*by, "_part").agg(F.sum(n).alias("_n")).select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_part").alias("_p2"), before(W.partitionBy(*by).orderBy("_part")).alias("_lead"))  # cuts rows a group
    on = F.col("_part") == F.col("_p2")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    inside = before(W.partitionBy(*by, "_part").orderBy(value))
    return c.withColumn("_n", F.col(n)).join(sums, on).withColumn("before", F.col("_lead") + inside).select(*counts.columns, "before")


def distribution(df: DataFrame, value: str, *by: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Count, least, mean, exact percentiles with linear interpolation, greatest. The percentiles are order statistics of value counts."""
    shares = shares or {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    some = df.where(F.col(value).isNotNull())
    counts = some.groupBy(*by, value).agg(F.count("*").alias("_c"))
    total = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.min(value).alias("least"), (F.sum(F.col(value).cast("double") * F.col("_c")) / F.sum("_c")).alias("mean"), F.max(value).alias("greatest"))
    upto = cumulative(counts, value, "_c", *by)
    rows = upto.join(total.select(*by, "n"), list(by)) if by else upto.crossJoin(total.select("n"))  # one row
    pos = {k: (F.col("n") - 1) * p for k, p in shares.items()}
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("_c")), F.col(value).cast("double")))
    ends = rows.groupBy(*by, "n").agg(*(at(f(x)).alias(f"{k}_{e}") for k, x in pos.items() for e, f in (("a", F.floor), ("b", F.ceil))))
    found = ends.select(*by, *((F.col(f"{k}_a") + (F.col(f"{k}_b") - F.col(f"{k}_a")) * (x - F.floor(x))).alias(k) for k, x in pos.items()))
    out = total.join(found, list(by)) if by else total.crossJoin(found)  # one row
    return out.select(*by, "n", "least", "mean", *shares, "greatest")


def entropy(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Shannon entropy in nats and share of the most common value, by group: sums over value counts."""
    c = df.groupBy(*by, key).agg(F.count("*").alias("c"))
    t = c.groupBy(*by).agg(F.sum("c").alias("n"), F.max("c").alias("top"))
    j = c.join(t, list(by)) if by else c.crossJoin(t)  # one row
    p = F.col("c") / F.col("n")
    return j.groupBy(*by, "n").agg((-F.sum(p * F.log(p + 1e-12))).alias("entropy"), F.max(F.col("top") / F.col("n")).alias("mode_share"))


def pivot_mean(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """Mean by two keys, one column a value of the second, 0 where there is none."""
    return df.groupBy(row).agg(*(F.coalesce(F.avg(F.when(F.col(column) == v, F.col(value))), F.lit(0.0)).alias(v.lower()) for v in values))


def duplicates(df: DataFrame, key: Column | str) -> DataFrame:
    """Rows, distinct keys, and rows beyond the first of their key."""
    g = df.groupBy((F.col(key) if isinstance(key, str) else key).alias("_k")).agg(F.count("*").alias("c"))
    return g.agg(F.sum("c").alias("rows"), F.count("*").alias("keys"), F.sum(F.greatest(F.col("c") - 1, F.lit(0))).alias("duplicates"))


def score_stats(scores: Column) -> Column:
    """top, second, mean, population deviation and margin of the four best scores, zeros where there are fewer."""
    four = F.slice(F.concat(F.sort_array(scores, asc=False), F.array_repeat(F.lit(0.0), 4)), 1, 4)
    mean = F.aggregate(four, F.lit(0.0), lambda a, v: a + v) / 4
    var = F.aggregate(four, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / 4
    return F.struct(four[0].alias("top"), four[1].alias("second"), mean.alias("mean"), F.sqrt(var).alias("deviation"), (four[0] - four[1]).alias("margin"))


def profile(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Rows and blank values of each column."""
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(blank(c).alias(f"blank_{c}") for c in columns))


def confusion(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    n = lambda x: F.count_if(x)
    g = df.groupBy(*by).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    r = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return g.select(*by, "tp", "fp", "fn", "tn", r("tp", "fp").alias("precision"), r("tp", "fn").alias("recall"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))


# -- ranking and sampling --------------------------------------------------------------------------
def first_seen(df: DataFrame, key: Column, position: str) -> DataFrame:
    """The first row of each key by position."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(position))).where("_r = 1").drop("_r")


def terciles(df: DataFrame, value: str, key: str) -> DataFrame:
    """low, mid or high by the order statistics at a third and two thirds; equal values share a bin.

    The thresholds come from value counts that are ordered range by range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    n = counts.agg(F.sum("c").alias("n")).first()["n"] or 0
    upto = cumulative(counts, value, "c").withColumn("upto", F.col("before") + F.col("c"))
    cut = upto.agg(F.min(F.when(F.col("upto") > n // 3, F.col(value))).alias("q1"), F.min(F.when(F.col("upto") > 2 * n // 3, F.col(value))).alias("q2"))
    return df.crossJoin(F.broadcast(cut)).select(key, value, F.when(F.col(value) <= F.col("q1"), "low").when(F.col(value) <= F.col("q2"), "mid").otherwise("high").alias("bin"))  # one row is sent


def hash_order(tag: str, key: str) -> Column:
    """An order that depends on the tag and the key alone."""
    return F.sha2(F.concat_ws("|", F.lit(tag), F.col(key).cast("string")), 256)


def hash_sample(df: DataFrame, key: str, n: int, tag: str) -> DataFrame:
    return df.orderBy(hash_order(tag, key), key).limit(n)


def quota_sample(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], tag: str) -> DataFrame:
    """Up to the quota of each stratum, in hash order. The largest quota is a literal bound, so every task keeps no more of a stratum before rows are dealt."""
    w = W.partitionBy(stratum).orderBy(hash_order(tag, key), key)
    quota = F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))))
    some = df.where(F.col(stratum).isin(*quotas)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(quotas.values()))
    return some.where(F.col("_r") <= F.try_element_at(quota, F.col(stratum))).drop("_r")


def one_of_each_within(df: DataFrame, outer: str, inner: str, key: str, n: int, tag: str) -> DataFrame:
    """One row an inner group within each outer group, then n of each outer group, in hash order."""
    a = df.withColumn("_r", F.row_number().over(W.partitionBy(outer, inner).orderBy(hash_order(tag, key), key))).where("_r = 1").drop("_r")
    return a.withColumn("_r", F.row_number().over(W.partitionBy(outer).orderBy(hash_order(tag, key), key))).where(F.col("_r") <= n).drop("_r")


def corruption_levels(df: DataFrame, key: str, levels: list[float], tag: str) -> DataFrame:
    """(key, level, corrupted): the first floor(n level) rows of one fixed order, so levels are nested.

    The order is cut by exact percent ranks of a 60-bit hash computed by value counts within 256 buckets.
    """
    h = df.select(key, hash_order(tag, key).alias("h")).withColumn("b", F.substring("h", 1, 2))
    per = h.groupBy("b").agg(F.count("*").alias("c"))
    before = per.select("b", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(W.partitionBy()).alias("n"))  # 256 rows
    r = h.join(F.broadcast(before), "b").withColumn("i", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", key)) - 1)
    each = r.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))
    return each.select(key, "level", (F.col("i") < F.floor(F.col("n") * F.col("level") + 1e-9)).alias("corrupted"))


def one_standard_error(candidates: DataFrame) -> DataFrame:
    """Of (name, mean, se, coverage, always_base, threshold, metric): within one error of the best the least coverage, then the base, the higher threshold, the better metric."""
    best = candidates.orderBy(F.desc("mean"), "name").limit(1).select((F.col("mean") - F.col("se")).alias("cutoff"))
    return candidates.crossJoin(F.broadcast(best)).where("mean >= cutoff - 1e-12").orderBy("coverage", F.desc("always_base"), F.desc("threshold"), F.desc("metric"), "name").limit(1).drop("cutoff")


# -- sets and joins --------------------------------------------------------------------------------
def left_with_default(gold: DataFrame, predictions: DataFrame, key: str, value: str, default) -> DataFrame:
    """Every gold row; a missing prediction takes the default and is marked."""
    p = predictions.select(key, F.col(value), F.lit(True).alias("_there"))
    return gold.join(p, key, "left").withColumn("missing", F.col("_there").isNull()).withColumn(value, F.coalesce(value, F.lit(default))).drop("_there")


def keyed_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(check, key): rows that only one side has, and rows that differ, null-safe."""
    j = a.select(key, F.struct(*columns).alias("x")).alias("a").join(b.select(key, F.struct(*columns).alias("y")).alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    kind = F.when(F.col("x").isNull(), "only_right").when(F.col("y").isNull(), "only_left").when(~F.col("x").eqNullSafe(F.col("y")), "differs")
    return j.select(kind.alias("check"), F.coalesce(f"a.{key}", f"b.{key}").alias(key)).where("check is not null")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of each side, of both, and the share of the left that is shared."""
    x, y = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    g = x.join(y, key, "full_outer").agg(F.count("l").alias("left_keys"), F.count("r").alias("right_keys"), F.count(F.col("l") + F.col("r")).alias("shared"))
    return g.withColumn("share", F.coalesce(F.try_divide("shared", "left_keys"), F.lit(0.0)))


def latest(caches: list[DataFrame], key: str) -> DataFrame:
    """Union of caches; of rows with one key that of the later cache stays."""
    u = None
    for i, c in enumerate(caches):
        c = c.withColumn("_n", F.lit(i))
        u = c if u is None else u.unionByName(c)
    return u.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_n")))).where("_r = 1").drop("_r", "_n")


def holdout(df: DataFrame, group: str, *used: DataFrame) -> DataFrame:
    """Rows whose group is in none of the used tables."""
    for u in used:
        df = df.join(u.select(group).distinct(), group, "left_anti")
    return df


def ranked_block(hits: DataFrame, key: str, rank: str, text: str) -> DataFrame:
    """Texts of a target's hits in rank order, joined by blank lines."""
    return hits.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda s: s[text]), "\n\n").alias("block"))


def averaged_pairs(left: DataFrame, pairs: DataFrame, value: str, keys: tuple[str, str] = ("target_id", "source_id")) -> DataFrame:
    """Mean of ``value`` over a target's matches on the composite key, by target; targets without a match have null and count 0."""
    got = left.join(pairs, list(keys), "left")
    return got.groupBy(keys[0]).agg(F.count(value).alias("matches"), F.avg(value).alias("mean"))


def marked(rows: DataFrame, audit: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with ``flag``: whether any audit row of their key says so; keys that were not audited are not marked."""
    bad = audit.groupBy(key).agg(F.bool_or(flag).alias(flag))
    return rows.join(bad, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def budget_plan(rows: DataFrame, key: str, plan: dict[str, tuple[Column, int]], tag: str) -> DataFrame:
    """(key, slot): for each named test so many rows, none twice; earlier tests choose first, by hash order.

    A row goes to the first tests that it passes; with what a full test leaves over the later ones are
    filled, so each test needs one pass over the rows that are left.
    """
    taken = None
    for slot, (test, n) in plan.items():
        left = rows if taken is None else rows.join(taken.select(key), key, "left_anti")
        some = left.where(test).orderBy(hash_order(tag, key), key).limit(n).select(key, F.lit(slot).alias("slot"))
        taken = some if taken is None else taken.unionByName(some)
    return taken


def best_by(results: DataFrame, name: str, *rates: str) -> DataFrame:
    """The row of the highest first rate, then second and so on, then the smallest name."""
    return results.orderBy(*(F.desc_nulls_last(r) for r in rates), name).limit(1)


def coverage_groups(rows: DataFrame, key: str, before: str, after: str, n: int, tag: str, least: float = 0.5) -> DataFrame:
    """(key, group): up to n rows whose coverage was repaired (below ``least`` before, at or above it after: A) and n that were covered all along (B)."""
    group = F.when((F.col(before) < least) & (F.col(after) >= least), "A").when((F.col(before) >= least) & (F.col(after) >= least), "B")
    w = W.partitionBy("group").orderBy(hash_order(tag, key), key)
    return rows.withColumn("group", group).where("group is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select(key, "group")


def first_n(df: DataFrame, position: str, n: int) -> DataFrame:
    """The first n rows by position."""
    return df.orderBy(position).limit(n)


def first_per(df: DataFrame, structure: str, key: str, n: int, tag: str) -> DataFrame:
    """n rows of each structure, first by hash order."""
    w = W.partitionBy(structure).orderBy(hash_order(tag, key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def top_structures(df: DataFrame, structure: str, top: int) -> DataFrame:
    """Rows of the ``top`` most frequent structures, ties by name."""
    best = df.groupBy(structure).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), structure).limit(top).select(structure)
    return df.join(best, structure, "left_semi")


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in both; empty if the sets are disjoint."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids in one set only: missing (only in a) or extra (only in b); empty if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(y.join(x, key, "left_anti").select(key, F.lit("extra").alias("side")))


def require_empty(faults: DataFrame, what: str, show: int = 5) -> None:
    """Fail with the first faults if there are any: the assertion form of the three above."""
    some = faults.limit(show).collect()  # show rows
    if some:
        raise AssertionError(f"{what}: {[tuple(r) for r in some]}")


def split_profile(df: DataFrame, columns: list[str], valid: dict[str, Column], *by: str) -> DataFrame:
    """By split: rows, missing values of each column, how many rows pass each test, and its rate among the rows; one pass."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    ok = lambda t: F.count_if(F.coalesce(t, F.lit(False)))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(blank(c)).alias(f"missing_{c}") for c in columns), *(ok(t).alias(f"valid_{k}") for k, t in valid.items()), *((ok(t) / F.count("*")).alias(f"rate_{k}") for k, t in valid.items()))


def shuffled_folds(df: DataFrame, key: str, k: int, tag: str, stratum: str | None = None) -> DataFrame:
    """df with ``fold``: rows in hash order dealt in turn, within each stratum if one is named, so folds differ by one row at most.

    The order is counted in parts of the hash, so no task holds a stratum.
    """
    h = F.conv(F.substring(hash_order(tag, key), 1, 15), 16, 10).cast("long")
    s = F.lit("") if stratum is None else F.col(stratum).cast("string")
    rows = df.withColumn("_h", h).withColumn("_s", s).withColumn("_part", F.shiftright("_h", 52))  # 256 parts
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_s", "_part").agg(F.count("*").alias("_c")).select(F.col("_s").alias("_s2"), F.col("_part").alias("_p2"), F.coalesce(F.sum("_c").over(before(W.partitionBy("_s").orderBy("_part"))), F.lit(0)).alias("_lead"))
    j = rows.join(sums, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_part") == F.col("_p2")))
    n = F.col("_lead") + F.row_number().over(W.partitionBy("_s", "_part").orderBy("_h", key)) - 1
    return j.withColumn("fold", (n % k).cast("int")).select(*df.columns, "fold")
