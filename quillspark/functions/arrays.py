"""Array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, use) -> Column:
    """``use(x)`` with x evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def years(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of the sets of two arrays; ``empty`` if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / u)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and replacements between two arrays of any items; one row of the table at a time."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(before: Column, x: Column) -> Column:
        start = F.array(F.get(before, F.lit(0)) + 1)
        cell = lambda acc, j: F.concat(acc, F.array(F.least(F.element_at(acc, -1) + 1, F.element_at(before, j + 1) + 1, F.element_at(before, j) + (~x.eqNullSafe(F.element_at(b, j))).cast("int"))))
        return F.when(F.size(b) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), start, cell))

    return F.element_at(F.aggregate(a, first, row), -1)


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance of two arrays over the longer length; 1 for two empty ones."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - edit_distance(a, b) / n)


def multiset_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two arrays of strings."""
    keys = F.array_distinct(F.concat(a, b))
    count = lambda arr, k: F.size(F.filter(arr, lambda v: v == k)).cast("double")
    fold = lambda f: F.aggregate(F.transform(keys, f), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(fold(lambda k: count(a, k) * count(b, k)), F.sqrt(fold(lambda k: count(a, k) * count(a, k))) * F.sqrt(fold(lambda k: count(b, k) * count(b, k)))), F.lit(0.0))


def bag_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two sets; an empty side counts as precision or recall 1."""
    i, p, g = F.size(F.array_intersect(predicted, gold)), F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    precision, recall = F.when(p == 0, 1.0).otherwise(F.try_divide(i, p)), F.when(g == 0, 1.0).otherwise(F.try_divide(i, g))
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def valid_refs(refs: Column, pool: Column) -> Column:
    """Each 0-based reference with whether it is in range and what it points at."""
    return F.transform(refs, lambda r: F.struct(r.alias("ref"), ((r >= 0) & (r < F.size(pool))).alias("valid"), F.when(r >= 0, F.get(pool, r)).alias("value")))


def keep_or_all(items: Column, test) -> Column:
    """The items that pass, or all of them if none does."""
    kept = F.filter(items, test)
    return F.when(F.size(kept) > 0, kept).otherwise(items)


def pair_facts(pairs: Column) -> Column:
    """``name: text`` of an array of two-element arrays; pairs without text go."""
    ok = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))) != ""))
    return F.transform(ok, lambda p: F.concat(F.trim(F.get(p, F.lit(0))), F.lit(": "), F.trim(F.get(p, F.lit(1)))))


def without_space(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", "")


def keep_keyword(items: Column, keyword: Column) -> Column:
    """Items that hold the keyword whatever the blanks in either, or all of them if none does."""
    return keep_or_all(items, lambda v: F.contains(without_space(v), without_space(keyword)))


def safe_features(features: Column, forbidden: str) -> Column:
    """Features (map of name to number) whose name does not match the forbidden pattern; null and NaN values go."""
    return F.map_filter(features, lambda k, v: ~k.rlike(forbidden) & v.isNotNull() & ~F.isnan(v))


def feature_group(features: Column, prefixes: list[str] = (), names: list[str] = ()) -> Column:
    """Features that begin with one of the prefixes or bear one of the names."""
    tests = lambda k: [*(k.startswith(p) for p in prefixes), *([k.isin(*names)] if names else [])]

    def test(k: Column, v: Column) -> Column:
        out = F.lit(False)
        for t in tests(k):
            out = out | t
        return out

    return F.map_filter(features, test)


def relevant(paragraphs: Column, orders: Column, keep_all: bool = True) -> Column:
    """Texts of the paragraphs (struct<order, text>) whose order is named, in their order; all of them if none is and ``keep_all``."""
    hit = lambda p: F.array_contains(orders, p["order"])
    kept = keep_or_all(paragraphs, hit) if keep_all else F.filter(paragraphs, hit)
    return F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(p["order"], p["text"]))), lambda p: p["text"])


def year_sets_agree(a: Column, b: Column) -> Column:
    """Whether two texts' years can be of one question: one names none, or they share one."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def one_hot(**values: Column) -> Column:
    """Map with an entry ``name=value`` of 1 for each value that is not null."""
    entries = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.concat(F.lit(f"{k}="), v.cast("string")).alias("key"), F.lit(1.0).alias("value"))) for k, v in values.items())))
    return F.map_from_entries(entries)


def clamped(values: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    """A map of numbers held within a range for each name; other names and nulls go."""
    low, high = (F.create_map(*(F.lit(x) for k, r in ranges.items() for x in (k, float(r[i])))) for i in (0, 1))
    kept = F.map_filter(values, lambda k, v: F.try_element_at(low, k).isNotNull() & v.isNotNull() & ~F.isnan(v))
    return F.transform_values(kept, lambda k, v: F.greatest(F.try_element_at(low, k), F.least(F.try_element_at(high, k), v)))


def as_list(x: Column) -> Column:
    """JSON text of a list, or any other text, as an array of strings; empty text is an empty list."""
    return F.when(F.trim(F.coalesce(x, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(F.when(F.trim(x).startswith("["), x), "array<string>"), F.array(x)))
