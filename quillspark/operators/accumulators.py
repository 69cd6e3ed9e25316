"""Accumulators as stored states: partial sums of a batch are written once, merged with others at any time and finished when asked.

A state is a row a key: counts, sums and, where asked for, the bytes of a quantile sketch. Merging is
adding, so batches may come in any order; a batch that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def states(rows: DataFrame, value: str, *by: str, weight: str | None = None, quantiles: bool = False) -> DataFrame:
    """(by, n, total, squares, least, most[, sketch]) of one batch; null values and weights add nothing, a weight counts a value so many times."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    v = F.col(value).cast("double")
    some = rows.where(v.isNotNull())
    more = [F.kll_sketch_agg_double(v).alias("sketch")] if quantiles else []
    return some.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(v * w).alias("total"), F.sum(v * v * w).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"), *more)


def commit(state: DataFrame, folder: str, batch: str) -> None:
    """Write a batch's states under its name; the same batch written again takes the place of what it wrote before, so a rerun counts once."""
    if not batch or "/" in batch:
        raise ValueError("a batch needs a name without slashes")
    state.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All committed states, with their batch."""
    return spark.read.option("basePath", folder).parquet(f"{folder.rstrip('/')}/batch=*")


def merged(state: DataFrame, *by: str) -> DataFrame:
    """States of any number of batches as one for each key; itself a state."""
    more = [F.kll_merge_agg_double("sketch").alias("sketch")] if "sketch" in state.columns else []
    return state.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"), *more)


def finished(state: DataFrame, *by: str) -> DataFrame:
    """(by, n, mean, sd, least, most[, median]) of merged states; a mean without weight is 0, ``sd`` is the population's."""
    mean = F.coalesce(F.try_divide("total", "n"), F.lit(0.0))
    sd = F.sqrt(F.greatest(F.coalesce(F.try_divide("squares", "n"), F.lit(0.0)) - mean * mean, F.lit(0.0)))
    more = [F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median")] if "sketch" in state.columns else []
    return state.select(*by, "n", mean.alias("mean"), sd.alias("sd"), "least", "most", *more)
