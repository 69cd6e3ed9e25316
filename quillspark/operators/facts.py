"""Facts retrieved within their own document, and whether they hold the numbers that an answer's program needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from .retrieval import hashed_vectors


def gold_numbers(program: Column) -> Column:
    """The numbers of a program as they occur, without constants (const_100) and step references (#0)."""
    return F.transform(F.regexp_extract_all(F.coalesce(program, F.lit("")), F.lit(r"(?<![a-z_#0-9.])(-?\d+(?:\.\d+)?)\s*%?"), F.lit(1)), lambda n: n.cast("double"))


def fact_numbers(facts: Column) -> Column:
    """Distinct numbers of an array of texts; grouping commas part them, as facts are stored without."""
    found = F.transform(facts, lambda f: F.regexp_extract_all(F.coalesce(f, F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)))
    return F.array_distinct(F.transform(F.flatten(found), lambda n: n.cast("double")))


def top_within(questions: DataFrame, facts: DataFrame, k: int, vec: str = "vector", digits: int = 5) -> DataFrame:
    """(id, rank, fact, score): the k facts of each question's own document that are nearest to it.

    questions (id, vector), facts (id, fact, vector), both keyed by the document: an equi-join, so a fact
    meets the questions of its document alone; a zero vector scores 0, ties go to the smaller fact.
    """
    q = questions.select("id", F.col(vec).alias("_q"))
    score = F.round(F.coalesce(A.cosine(F.col("_q"), F.col(vec)), F.lit(0.0)), digits)
    scored = facts.join(q, "id").select("id", "fact", score.alias("score"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "fact"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)  # a literal bound: each task keeps k a group


def top_facts(questions: DataFrame, facts: DataFrame, k: int, dims: int = 64) -> DataFrame:
    """(id, rank, fact, score, text) from texts: questions (id, text), facts (id, fact, text), encoded without a model."""
    keyed = facts.withColumn("_key", F.struct("id", "fact"))
    vectors = hashed_vectors(keyed, "_key", "text", dims).select("_key.id", "_key.fact", "vector")
    return top_within(hashed_vectors(questions, "id", "text", dims), vectors, k).join(facts.select("id", "fact", "text"), ["id", "fact"])


def operand_coverage(questions: DataFrame, top: DataFrame, program: str = "program") -> DataFrame:
    """(id, wanted, found, coverage, covered): how many of the program's numbers the retrieved facts hold, and whether it is all of them (at least one)."""
    held = top.groupBy("id").agg(F.collect_list("text").alias("facts"))  # k texts
    x = questions.join(held, "id", "left").withColumn("n", gold_numbers(F.col(program))).withColumn("f", fact_numbers(F.coalesce("facts", F.array().cast("array<string>"))))
    found = F.size(F.filter("n", lambda v: F.array_contains(F.col("f"), v)))
    return x.select("id", F.size("n").alias("wanted"), found.alias("found"), F.coalesce(F.try_divide(found, F.size("n")), F.lit(0.0)).alias("coverage"), ((F.size("n") > 0) & (found == F.size("n"))).alias("covered"))
