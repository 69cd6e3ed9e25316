"""Optimal one-to-one alignment of bags of words, for whole batches of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..shipping import ship


def f1(a: Column, b: Column, need_number: bool = False) -> Column:
    """F1 of two bags as sets of words, an empty one precise; with ``need_number`` 0 where the gold bag b has numbers and a none of them."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    p = F.when(F.size(a) == 0, 1.0).otherwise(F.try_divide(both, F.size(a)))
    r = F.when(F.size(b) == 0, 1.0).otherwise(F.try_divide(both, F.size(b)))
    out = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    if need_number:
        numbers = F.filter(b, lambda w: R.is_number(w))
        out = F.when((F.size(numbers) > 0) & (F.size(F.array_intersect(numbers, a)) == 0), 0.0).otherwise(out)
    return out


def f1_matrix(predicted: Column, gold: Column, need_number: bool = False) -> Column:
    """F1 of every predicted bag (rows) with every gold bag (columns)."""
    return F.transform(predicted, lambda a: F.transform(gold, lambda b: f1(a, b, need_number)))


def assign(cost: np.ndarray) -> np.ndarray:
    """The least sum of a one-to-one assignment for each matrix of a stack (rows, n, n): shortest augmenting paths, all rows of the stack in step."""
    size, n, _ = cost.shape
    at = np.arange(size)
    u, v = np.zeros((size, n + 1)), np.zeros((size, n + 1))
    match = np.zeros((size, n + 1), np.int64)  # the row that holds each column; column 0 is where a path starts
    for i in range(1, n + 1):
        match[:, 0] = i
        j = np.zeros(size, np.int64)
        least, came, done = np.full((size, n + 1), np.inf), np.zeros((size, n + 1), np.int64), np.zeros((size, n + 1), bool)
        live = np.ones(size, bool)
        while live.any():
            r = at[live]
            done[r, j[r]] = True
            row = match[r, j[r]]
            c = cost[r, row - 1] - u[r, row][:, None] - v[r, 1:]
            open_ = ~done[r, 1:]
            better = open_ & (c < least[r, 1:])
            least[r, 1:] = np.where(better, c, least[r, 1:])
            came[r, 1:] = np.where(better, j[r][:, None], came[r, 1:])
            reach = np.where(open_, least[r, 1:], np.inf)
            to = reach.argmin(1)
            step = reach[np.arange(len(r)), to]
            for k in range(n + 1):  # potentials of what the path has seen
                seen = done[r, k]
                u[r[seen], match[r[seen], k]] += step[seen]
                v[r[seen], k] -= step[seen]
                least[r[~seen], k] -= step[~seen]
            j[r] = to + 1
            live[r] = match[r, j[r]] > 0
        back = j > 0
        while back.any():
            r = at[back]
            p = came[r, j[r]]
            match[r, j[r]] = match[r, p]
            j[r] = p
            back[r] = p > 0
    return cost[at[:, None], match[:, 1:] - 1, np.arange(n)[None, :]].sum(1)


def best_means(matrices: list) -> np.ndarray:
    """For each score matrix the mean of the best one-to-one alignment over the longer side, what is left over counting 0; 1 for two empty sides, NaN for null."""
    out = np.full(len(matrices), np.nan)
    shapes: dict[int, list[int]] = {}
    for i, (m, columns) in enumerate(matrices):
        if m is not None:
            shapes.setdefault(max(len(m), columns), []).append(i)
    for n, rows in shapes.items():
        if not n:
            out[rows] = 1.0
            continue
        stack = np.zeros((len(rows), n, n))
        for k, i in enumerate(rows):
            for x, line in enumerate(matrices[i][0]):
                stack[k, x, : len(line)] = line
        out[rows] = -assign(-stack) / n
    return out


def aligned(df: DataFrame, predicted: str, gold: str, name: str = "f1", need_number: bool = False) -> DataFrame:
    """df with the mean F1 of the best alignment of two arrays of bags, two places; null if either is null.

    Scores are made by expressions; the assignment runs over all rows of a batch that have one size.
    """
    ship(df.sparkSession)
    x = df.withColumn("_m", f1_matrix(F.col(predicted), F.col(gold), need_number)).withColumn("_n", F.size(gold))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means = best_means(list(zip(b.column("_m").to_pylist(), (max(0, n or 0) for n in b.column("_n").to_pylist()), strict=True)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in df_columns), pa.array(means, mask=np.isnan(means))], names=[*df_columns, name])

    df_columns = df.columns
    return x.mapInArrow(run, schema).withColumn(name, F.round(name, 2))
