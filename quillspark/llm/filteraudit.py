"""Audit of how filters interact, by inclusion-exclusion over joint failures.

For each set S of filters the documents that fail all of S are counted as a sum of products of flags:
32 sums a part, for all documents, for the good and for the toxic ones. Möbius inversion turns them into
the documents that fail exactly a set, so survivors of any order of filters, unique and redundant
failures and Shapley values (from the Harsanyi dividends) follow without another look at a document.

Scale. One pass over the texts leaves a digest and four flags a document. Rows that repeat are counted
before anything is joined, so neither a repeated id, nor a null one, nor a text that a third of all
rows repeat is one task's work; from the sums on there is one row a part.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import park

FILTERS = "ABCDE"
#: Fewest words; least share of distinct words and most share of capitals in hundredths; signs that must not occur.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
#: Tasks that null ids are dealt to where labels are joined.
SPREAD = 1024


def flags(text: Column) -> dict[str, Column]:
    """The filters of a text alone: A few words, B few distinct words, C many capitals, D signs. 1 where it fails."""
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    got = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "words": got,
        "c": (100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text)).cast("long"),
        "d": text.rlike(SIGNS).cast("long"),
    }


def joint_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, all, good, toxic): for each part three arrays of 32 counts, entry S counts the rows that fail every filter of S (A is bit 0).

    E holds where the text (null: empty) stands with any smaller id; equal texts are told by their SHA-256.
    Rows with a null id fail no E and make no other row fail it. Of labels that repeat an id
    one that is 1 is enough; other and null labels count as 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = flags(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), seen["words"].alias("w"), seen["c"].alias("c"), seen["d"].alias("d"))
    rows = rows.select("id", "part", "key", (F.col("w.n") < LEAST_WORDS).cast("long").alias("a"), (100 * F.col("w.d").cast("long") < LEAST_DISTINCT * F.col("w.n").cast("long")).cast("long").alias("b"), "c", "d")
    rows = rows.groupBy("id", "part", "key", "a", "b", "c", "d").agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(n) for n, c in (("good", quality), ("toxic", toxic))))
    # a null id meets no label: its rows may go anywhere
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int"))
    rows = rows.join(marks.withColumn("salt", F.lit(0)), ["id", "salt"], "left")
    rows = rows.select("id", "part", "key", "a", "b", "c", "d", "n", *(F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in ("good", "toxic")))
    # rows of one text become one row for each part and label, with how many of them have the smallest id
    same = rows.groupBy("key", "part", "a", "b", "c", "d", "good", "toxic", "id").agg(F.sum("n").alias("n"))
    same = same.groupBy("key", "part", "a", "b", "c", "d", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"))
    first = F.min("low.id").over(W.partitionBy("key"))  # a row for each part and label of a text
    kept = F.col("unnamed") + F.when(F.col("low.id") == first, F.col("low.n")).otherwise(0)
    same = same.withColumn("late", F.col("n") - kept)
    fails = [F.col(f) for f in "abcd"]

    def joint(s: int, mark: Column) -> Column:
        product = reduce(lambda x, y: x * y, [f for i, f in enumerate(fails) if s >> i & 1], mark)
        return F.sum(product * F.col("late" if s & 16 else "n"))

    counts = {"all": F.lit(1).cast("long"), "good": F.col("good"), "toxic": F.col("toxic")}
    return same.groupBy("part").agg(*(F.array(*(joint(s, m) for s in range(32))).alias(k) for k, m in counts.items()))


def _subsets(values: Column, sign_by_size: bool) -> Column:
    """For each set P the sum of the values of its subsets, signed by (-1)^size where asked for."""
    every = F.sequence(F.lit(0), F.lit(31))
    signed = F.transform(values, lambda v, s: F.when(F.bit_count(s) % 2 == 1, -v).otherwise(v)) if sign_by_size else values
    return F.transform(F.array(signed), lambda vs: F.transform(every, lambda p: F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(p) == s, F.get(vs, s)).otherwise(F.lit(0).cast("long")))))[0]


def exact_failures(values: Column) -> Column:
    """For each set T the rows that fail exactly T, from joint failures: the Möbius inversion over supersets."""
    every = F.sequence(F.lit(0), F.lit(31))
    sign = lambda t, s: F.when((F.bit_count(s) - F.bit_count(t)) % 2 == 1, F.lit(-1)).otherwise(F.lit(1))
    return F.transform(F.array(values), lambda vs: F.transform(every, lambda t: F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(t) == t, F.get(vs, s) * sign(t, s)).otherwise(F.lit(0).cast("long")))))[0]


def shapley_sums(values: Column, filters: int = 5) -> Column:
    """For each filter its removals summed over all orders: its share of each dividend, (-1)^(size + 1) times the joint failures, times the number of orders."""
    every, orders = F.sequence(F.lit(1), F.lit((1 << filters) - 1)), reduce(lambda x, y: x * y, range(1, filters + 1))
    share = lambda s: F.when(F.bit_count(s) % 2 == 1, F.lit(orders)).otherwise(F.lit(-orders)) / F.bit_count(s)
    return F.transform(F.array(values), lambda vs: F.transform(F.sequence(F.lit(0), F.lit(filters - 1)), lambda f: F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.when(F.get(F.array(*(F.lit(1 << i) for i in range(filters))), f).bitwiseAND(s) != 0, F.get(vs, s) * share(s).cast("long")).otherwise(F.lit(0).cast("long")))))[0]


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    Null parts are the part of the empty string; an empty table has none. Empty texts have no words: they
    fail A alone, and E where an earlier one stands. Rows that repeat an id are rows of their own; of
    several with the same text and the smallest id none fails E. Very long texts are counted whole.
    """
    sums = park(joint_failures(docs, labels, **columns))
    ready = sums.select("part", "all", *(_subsets(F.col(c), True).alias(f"kept_{c}") for c in ("all", "good", "toxic")), exact_failures(F.col("all")).alias("exact"), shapley_sums(F.col("all")).alias("shapley"))
    steps = []
    for order in permutations(range(len(FILTERS))):  # 600 fixed rows
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>")
    out = ready.select("*", F.inline(table))
    gone = lambda c: F.get(F.col(f"kept_{c}"), F.col("before")) - F.get(F.col(f"kept_{c}"), F.col("after"))
    bit = F.get(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.col("f"))
    return out.select(
        "part", "filter_order", "step", F.get("kept_all", F.col("after")).alias("kept"), gone("all").alias("removed"), (F.get("all", bit) - gone("all")).alias("redundant"),
        F.get("exact", bit).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shapley", F.col("f")).alias("shapley"),
    )


def op12(spark, sf_dir):
    """Full result over ``documents`` and ``labels``."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Filters applied one after another, document by document.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
  [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(x.doc_id > low, false)] AS fails
  FROM x LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = x.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT [a, b, c, d, e] AS o FROM range(1, 6) ra(a), range(1, 6) rb(b), range(1, 6) rc(c), range(1, 6) rd(d), range(1, 6) re(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT o, list_transform(o, lambda i: substr('ABCDE', i::INT, 1)) AS letters, unnest(range(1, 6)) AS step FROM p),
r AS (SELECT part, array_to_string(letters, '') AS filter_order, step::INT AS step, o[step] AS f,
  sum(CASE WHEN NOT list_bool_or(list_transform(o[:step], lambda i: fails[i])) THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda i: fails[i])), false) THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails[o[step]] AND coalesce(list_bool_or(list_transform(o[:step - 1], lambda i: fails[i])), false) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails[o[step]] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN good AND fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda i: fails[i])), false) THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN toxic AND fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda i: fails[i])), false) THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
