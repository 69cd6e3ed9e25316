"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to token budgets.

Each document draws an exponential key divided by its quality weight; within a source the documents
with the smallest keys come first. A source's target is met by as many complete epochs as fit, then by
documents in key order until the rest is used up. The prefix sums are in three levels: keys fall into
bins, bins into shelves; shelves and bins are summed, and only within a bin are rows ordered in one
task. Bins are equally wide in the logarithm of the key, whose density is at most 1/e whatever the
weights are, so no bin holds many more than ``BIN_ROWS`` rows and a source that holds most rows is
spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, lean, park
from .textkit import groups, words

#: Weights of the sources in code-point order, repeating; share of all sizes that is taken; most repeats of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents that a bin of keys holds at most on average, and bins of a shelf.
BIN_ROWS, SHELF = 2_000, 1_024
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "!#$%&*|"]] = True


def measured(docs: DataFrame, text_col: str, *names: str, scorer: object | None = None) -> DataFrame:
    """docs with the words of each whole text (0 for null) and its weight in columns of these two names.

    ``scorer`` is a model whose score is the weight (0.05 at least), in the same pass; without one:

    the weight goes from 0.05 to 1, texts with many signs such as ``#`` or ``*`` weigh less. One pass
    over the bytes, row by row; the text itself is not returned.
    """
    arrow_rows(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.DoubleType())])

    sent = None if scorer is None else docs.sparkSession.sparkContext.broadcast(scorer)  # a few MB, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, weight = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, buf, off in groups(b.column(text_col)):
                count = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[off])  # noqa: B023, E731
                n, odd = count((buf & 0xC0) != 0x80), count(_SIGN[buf])
                size.append(np.diff(words(buf, off)[2]))
                if sent is not None:
                    weight.append(np.maximum(0.05, sent.value.score(buf, off)))
                    continue
                weight.append(0.05 + np.where(n > 0, 0.95 * (1 - np.minimum(1.0, 8.0 * odd / np.maximum(n, 1))), 0.0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(weight), pa.float64())], names=[*keep, *names])

    return docs.mapInArrow(lean(run), schema)


def uniform(id_col: Column, text_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on id, text and seed alone: rows that share an id, or have none, draw each their own."""
    own = F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce(text_col, F.lit(""))))
    h = F.conv(F.substring(F.md5(own), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares of ``share`` times all sizes, water-filled below ``most`` times a source's size.

    The sources are a table: with the ratio r = most * size / weight in ascending order, those below the
    level are full, so the level is the first at which the rest by weight fits the next source. One
    row a source goes through the two windows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("k", F.row_number().over(order) - 1)
    t = t.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int")))
    every = W.partitionBy()
    t = t.withColumn("cap", F.col("source_size") * float(most)).withColumn("budget", F.sum("source_size").over(every) * share)
    ratio = W.orderBy(F.col("cap") / F.col("w"), "k")
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.col("budget") - F.col("full")) / F.col("left_w"))
    # the first source whose cap is at or above its part sets the level for itself and all after it
    t = t.withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    t = t.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def take(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, mark: Column | None = None, quality: str | None = None, scorer: object | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, one row for each input row.

    A source's words are its complete epochs plus documents in key order; the document at which the
    budget ends gives the words that are left. Texts without words give nothing. Null sources are a
    source of their own and stand last. Rows that repeat an id and text draw the same key and are
    ordered by their size; equal rows follow one another, each with its own share. ``mark`` of a row is
    carried as a sixth column and orders rows that are equal but for it. ``quality`` names a column of
    document weights (a classifier's score; null, NaN and anything below 0.05 count as 0.05), ``scorer`` is
    a model that gives them; without either texts with many signs weigh less.
    """
    own = [] if quality is None else [F.greatest(F.coalesce(F.nanvl(F.col(quality).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.05)).alias("weight")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"), *own, *([] if mark is None else [mark.alias("mark")]))
    rows = measured(rows, "text", "size", "signs", scorer=scorer)
    rows = rows.select("doc_id", "source", "size", (-F.log("u") / F.col("signs" if quality is None else "weight")).alias("key"), *([] if mark is None else ["mark"]))
    more_columns = rows.columns[4:]
    rows = park(rows)
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    target = source_targets(total.select("source", "source_size"), weights, share, most).join(total.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    target = park(target)
    rows = rows.join(target.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    rows = rows.withColumn("bin", F.floor(F.log(F.greatest(F.col("key"), F.lit(1e-300))) * F.greatest(F.col("n") / (BIN_ROWS * math.e), F.lit(0.01))).cast("long")).withColumn("shelf", F.floor(F.col("bin") / SHELF))
    bins = rows.groupBy("source", "shelf", "bin").agg(F.sum("size").alias("in_bin"))
    shelves = bins.groupBy("source", "shelf").agg(F.sum("in_bin").alias("in_shelf"))
    so_far = lambda what, *by: F.coalesce(F.sum(what).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shelves = shelves.select(F.col("source").alias("s2"), F.col("shelf").alias("h2"), so_far("in_shelf", "source", "shelf").alias("before_shelf"))
    sums = bins.join(shelves, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shelf") == F.col("h2"))).select("source", "bin", (F.col("before_shelf") + so_far("in_bin", "source", "shelf", "bin")).alias("before_bin"))
    sums = sums.select(F.col("source").alias("s2"), F.col("bin").alias("b2"), "before_bin")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bin") == F.col("b2")))
    inside = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *more_columns).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("before_bin") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor((F.col("target") + 1e-6) / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("rest", F.floor(F.col("target") + 1e-6).cast("long") - epochs * F.col("source_size"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + more).cast("long").alias("taken"), *more_columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full result over ``documents``."""
    return take(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  -ln((('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
  / CASE WHEN length(text) > 0 THEN 0.05 + 0.95 * (1 - least(1.0::DOUBLE, 8.0::DOUBLE * (length(text) - length(translate(text, '!#$%&*|', '')))::DOUBLE / length(text)::DOUBLE)) ELSE 0.05::DOUBLE END AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) AS k FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
r AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0)) AS level0 FROM c WINDOW o AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, first_value(CASE WHEN cap >= level0 * w THEN level0 END IGNORE NULLS) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor((target + 1e-6) / source_size)::BIGINT ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target + 1e-6)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM e
"""


def mixed_documents(docs: DataFrame, seed: str = "mix-1", quality: str | None = None, scorer: object | None = None) -> DataFrame:
    """The documents of the mix: whole texts, each row as often as the nearest whole number to taken / size says; columns as they were, but that of ``quality`` (see ``take``) goes.

    Rows meet their copies by id (null is an id) and a 128-bit mark of the whole row. Rows that are equal
    throughout are given out by one of them, as often as all of them together.
    """
    cols = [c for c in docs.columns if c != quality]
    by_mark = F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("mark"), *cols).alias("b"))
    got = take(docs, seed=seed, mark=by_mark, quality=quality, scorer=scorer).withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0))
    got = park(got.groupBy(F.col("doc_id").alias("id2"), F.col("mark").alias("mark2")).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("m")).where("copies > 0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by_mark.alias("mark"), F.struct(*cols).alias("row"))
    on = (F.col("mark.a") == F.col("mark2.a")) & (F.col("mark.b") == F.col("mark2.b")) & F.col("doc_id").eqNullSafe(F.col("id2"))
    out = rows.join(got.where("m = 1"), on).select("row", "copies")
    several = got.where("m > 1")
    if not several.isEmpty():
        out = out.unionByName(rows.join(several, on).groupBy("id2", "mark2").agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row")[c].alias(c) for c in cols))
