"""Policies that choose an arm for each sample, and how they are tuned: thresholds, gain against harm, gates; ``nested`` runs them over folds.

A policy reads predictions in columns (one for each arm) and writes ``chosen``. Grids are small lists of
parameters; each candidate's mean value comes from one pass over the rows with the grid exploded.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .outcomes import hit
from .selectors import fit_predict, vectorize, vocabulary

# The grids that policies are tuned over.
THRESHOLDS = (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.33, 0.5)
GATES = (0.4, 0.5, 0.6, 0.7, 0.8)
LAMBDAS = (1.0, 1.5, 2.0, 3.0)
# The arm that asks for a wider gate, by how much, and the widest.
WARY, MORE, WIDEST = "case", 0.15, 0.95


def _top(scores: dict[str, Column]) -> Column:
    low = F.lit(float("-inf"))
    return F.greatest(low, low, *(F.coalesce(s, low) for s in scores.values()))


def best_arm(scores: dict[str, Column], prior: tuple[str, ...]) -> Column:
    """The arm of the highest score; ties go to the arm that stands first in ``prior``. Null scores never win."""
    top = _top(scores)
    return F.coalesce(*(F.when(scores[a] == top, F.lit(a)) for a in prior if a in scores))


def by_delta(deltas: dict[str, Column], threshold: Column | float, base: str, prior: tuple[str, ...]) -> Column:
    """The arm of the largest predicted gain over the base if that exceeds the threshold, else the base."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(_top(deltas) > t, best_arm(deltas, prior)).otherwise(F.lit(base))


def by_gain_and_harm(gain: dict[str, Column], harm: dict[str, Column], lam: Column | float, threshold: Column | float, base: str, prior: tuple[str, ...]) -> Column:
    """As ``by_delta`` with the chance of a gain less ``lam`` times the chance of a harm."""
    f = lam if isinstance(lam, Column) else F.lit(lam)
    return by_delta({a: gain[a] - f * harm[a] for a in gain}, threshold, base, prior)


def by_gate(gate: Column, arms: dict[str, Column], threshold: Column | float, base: str, prior: tuple[str, ...], wary: str = WARY, more: float = MORE, most: float = WIDEST) -> Column:
    """The base unless the gate exceeds the threshold; then the best arm. The wary arm asks for a wider gate, and if it is not wide enough the base stays (never the second-best arm)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    arm = best_arm(arms, prior)
    return F.when(gate <= t, F.lit(base)).when((arm == wary) & (gate <= F.least(F.lit(most), t + more)), F.lit(base)).otherwise(arm)


def value_of(chosen: Column, arms: tuple[str, ...]) -> Column:
    """The outcome of the chosen arm, from one column for each arm."""
    return F.coalesce(*(F.when(chosen == a, hit(a)) for a in arms))


def grid_table(rows: DataFrame, grid: list[dict], chosen, arms: tuple[str, ...], base: str) -> DataFrame:
    """One row a candidate of the grid: its parameters with mean, se, coverage (share of rows that leave the base).

    ``chosen`` makes the choice from the candidate's column of parameters.
    """
    names = sorted({k for g in grid for k in g})
    cell = lambda g: F.struct(*(F.lit(float(g[k])).alias(k) if g.get(k) is not None else F.lit(None).cast("double").alias(k) for k in names))
    each = rows.withColumn("_g", F.explode(F.array(*map(cell, grid))))
    each = each.withColumn("_c", chosen(F.col("_g"))).withColumn("_v", value_of(F.col("_c"), arms))
    return each.groupBy(*(F.col(f"_g.{k}").alias(k) for k in names)).agg(F.avg("_v").alias("mean"), (F.stddev_samp("_v") / F.sqrt(F.count("_v"))).alias("se"), F.avg((F.col("_c") != base).cast("double")).alias("coverage"))


def recall_by_class(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(class, n, recall, precision, f1) of each actual class; ratios without a denominator are 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    ends = df.select(F.explode(F.array(F.struct(F.col(actual).alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col(actual) == F.col(predicted)).cast("int").alias("h")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("e")).select("e.*")
    c = ends.groupBy("class").agg(F.sum("a").alias("n"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    c = c.select("class", "n", ratio(F.col("h"), F.col("n")).alias("recall"), ratio(F.col("h"), F.col("p")).alias("precision"))
    return c.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def selector_metrics(df: DataFrame, predicted: str, actual: str, harmful: str) -> DataFrame:
    """(macro_f1, accuracy, avoidance): mean f1 of the classes, share of right choices, and of the samples on which the ``harmful`` choice is wrong how many avoid it."""
    macro = recall_by_class(df, predicted, actual).agg(F.avg("f1").alias("macro_f1"))
    rest = df.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"), F.avg(F.when(F.col(actual) != harmful, (F.col(predicted) != harmful).cast("double"))).alias("avoidance"))
    return macro.crossJoin(rest)  # one row each


def regress(train: DataFrame, test: DataFrame, features: str, target: str, model: str = "ridge") -> DataFrame:
    """test with ``predicted``: a regression of the target on an open feature map; ``ridge`` or ``tree``."""
    names = vocabulary(train, features)
    tr, te = (vectorize(x, features, names) for x in (train, test))
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=False, withStd=True).fit(tr)
    tr = scale.transform(tr).withColumn("_y", F.col(target).cast("double"))
    est = LinearRegression(featuresCol="_x", labelCol="_y", regParam=1.0, elasticNetParam=0.0, predictionCol="predicted") if model == "ridge" else DecisionTreeRegressor(featuresCol="_x", labelCol="_y", maxDepth=4, seed=7, predictionCol="predicted")
    return est.fit(tr).transform(scale.transform(te)).select(*test.columns, "predicted")


def classify(train: DataFrame, test: DataFrame, features: str, label: str, model: str = "tree") -> DataFrame:
    """test with ``p`` by a tree or a small network; other models are those of ``selectors.fit_predict``."""
    if model not in ("tree", "mlp"):
        return fit_predict(train, test, features, label, model)
    names = vocabulary(train, features)
    tr, te = (vectorize(x, features, names) for x in (train, test))
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=False, withStd=True).fit(tr)
    tr = scale.transform(tr).withColumn("_y", F.col(label).cast("double"))
    est = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=4, seed=7) if model == "tree" else MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=[max(1, len(names)), 8, 2], maxIter=50, seed=7)
    out = est.fit(tr).transform(scale.transform(te))
    return out.withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")
