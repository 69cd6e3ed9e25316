"""Tests and resampling over paired outcomes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import cumulative


#: Logarithms of 0! to 15!; larger ones come from a series.
_SMALL = [math.lgamma(k + 1) for k in range(16)]


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, to about 1e-13 of its size."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < len(_SMALL), F.get(F.array(*map(F.lit, _SMALL)), F.greatest(F.least(n, F.lit(len(_SMALL) - 1)), F.lit(0)).cast("int"))).otherwise(series)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts; 1 if there are none.

    The tail starts at its largest term and each further one is a ratio of the one before; twelve
    deviations on they add nothing a double can hold, so a row has about the root of its count in terms.
    """
    n, m = (b + c).cast("long"), F.greatest(b, c).cast("long")
    terms = F.least(n - m, F.ceil(6 * F.sqrt(n.cast("double"))).cast("long") + 60)

    def add(acc: Column, j: Column) -> Column:
        term = F.when(j == 0, F.lit(1.0)).otherwise(acc["t"] * (n - m - j + 1) / (m + j))
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), terms), F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s")), add, lambda acc: acc["s"])
    first = F.exp(log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * math.log(2))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * first * tail))


#: Draws are numbers below this prime; their upper 16 bits pick how often a row is drawn. Rows that are drawn for all resamples at a time.
PRIME, ROWS = (1 << 31) - 1, 16
#: Entry u: the Poisson number of mean 1 whose distribution function first passes u / 65536.
TIMES = np.searchsorted([sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)], np.arange(1 << 16) / (1 << 16), "right").astype(np.uint8)


def _number(*parts: Column | str, digit: int = 1) -> Column:
    """28 bits of a hash, seven of its hex digits from ``digit`` on."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))), digit, 7), 16, 10).cast("long")


def resampled(rows: DataFrame, key: str, reps: int, seed: int, **values: Column) -> DataFrame:
    """(rep, values): for each resample the sums of the values, each row as often as it is drawn.

    A Poisson number of mean 1 stands for the draws with replacement. It follows from hashes of key, seed
    and resample, so nothing is numbered or gathered and a lost task draws the same again. A task keeps one
    sum for each resample and value and emits them once: tasks x reps rows are shuffled, never rows x reps.
    Resample -1 draws each row once. Null values add nothing.
    """
    ship(rows.sparkSession)
    names = list(values)
    drawn = rows.select(_number(str(seed), F.col(key).cast("string")).alias("a"), _number(str(seed), F.col(key).cast("string"), digit=8).alias("b"), *(v.cast("double").alias(n) for n, v in values.items()))
    r = np.array([int(hashlib.md5(f"{seed}|rep|{i}".encode()).hexdigest()[:7], 16) + 1 for i in range(reps)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((len(names), reps)), np.zeros(len(names))
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            v = np.stack([batch.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in names])
            plain += v.sum(1)
            for i in range(0, len(a), ROWS):
                x = a[i : i + ROWS, None] * r + b[i : i + ROWS, None]
                x -= x // PRIME * PRIME
                x *= x
                x -= x // PRIME * PRIME
                total += v[:, i : i + ROWS] @ TIMES[x >> 15].astype(np.float64)
        every = np.concatenate([plain[:, None], total], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, reps)), *map(pa.array, every)], names=["rep", *names])

    # rows are narrow and draws are not: every core gets its part, whatever the bytes
    spark = rows.sparkSession
    drawn = drawn.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    sums = drawn.mapInArrow(run, "rep long, " + ", ".join(f"`{n}` double" for n in names))
    return sums.groupBy("rep").agg(*(F.sum(n).alias(n) for n in names))


def cluster_bootstrap(values: DataFrame, group: str, value: str, reps: int, seed: int) -> DataFrame:
    """Percentile interval of the mean when groups are resampled with replacement; rows are summed by group first."""
    g = values.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    d = resampled(g, group, reps, seed, s=F.col("s"), c=F.col("c")).where("rep >= 0").select((F.col("s") / F.col("c")).alias("m"))
    return d.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg("m").alias("mean"))  # reps rows


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, reps: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """(diff, low, high): the mean of a - b over pairs and its percentile interval when pairs are resampled. Pairs with a null are left out."""
    d = pairs.select(key, (F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d is not null")
    m = resampled(d, key, reps, seed, d=F.col("d"), n=F.lit(1)).select("rep", (F.col("d") / F.col("n")).alias("m"))
    drawn = F.when(F.col("rep") >= 0, F.col("m"))
    return m.agg(F.max(F.when(F.col("rep") < 0, F.col("m"))).alias("diff"), F.percentile(drawn, F.lit(alpha / 2)).alias("low"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("high"))  # reps rows


def class_means(df: DataFrame, by: str, *values: str) -> DataFrame:
    """Count and means of diagnostics by outcome class."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(F.col(v).cast("double")).alias(v) for v in values))


def average_ranks(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, rank): the mean rank of each distinct value within its group, counted range by range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return cumulative(counts, value, "_c", *by).select(*by, value, (F.col("before") + (F.col("_c") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, a: str, b: str, *by: str, least: int = 10) -> DataFrame:
    """Rank correlation with average ranks, by group; null below ``least`` rows or without variance."""
    some = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    r = some.join(average_ranks(some, a, *by).withColumnRenamed("rank", "x"), [*by, a]).join(average_ranks(some, b, *by).withColumnRenamed("rank", "y"), [*by, b])
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))
    return g.withColumn("rho", F.when((F.col("n") >= least) & ~F.isnan("rho"), F.col("rho")))


def standard_error(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
