"""Selectors over arm outcomes: grouped folds, open feature maps, per-arm models, thresholds by one standard error."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups that are ranked in one task on average, and most bins of groups. They place work; folds are the same whatever they are.
BIN_GROUPS, MOST_BINS = 50_000, 256
#: Features up to which vectors are made by expressions; more are made sparse in Python, to the same values.
VOCABULARY = 4_096


def deal(classes: list[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, [(first rank, folds in turn)]) of the greedy deal of (size, groups of that size) to k folds.

    Groups of one size go to the folds as their loads come in ascending order, so a fold takes part once
    the others have reached its load, and between two such events the folds take turns: at most k spans.
    """
    load, out = [0] * k, []
    for n, m in sorted(classes, reverse=True):
        wait = sorted((load[i], i) for i in range(k))
        turn, spans, rank = [wait.pop(0)], [], 0
        while rank < m:
            left = m - rank
            if wait:
                left = min(left, sum(max(0, -((x - wait[0][0] - (i < wait[0][1])) // n)) for x, i in turn))
            if left:
                spans.append((rank, [i for _, i in turn]))
                rounds, more = divmod(left, len(turn))
                turn = sorted((x + n * (rounds + (j < more)), i) for j, (x, i) in enumerate(turn))
                rank += left
            if wait and rank < m:
                turn = sorted([*turn, wait.pop(0)])
        for x, i in turn:
            load[i] = x
        out.append((n, spans))
    return out


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): largest group first to the lightest fold, ties by group; no group is in two folds.

    Only the number of groups of each size comes to the driver (their sizes differ, so there are at most
    about the root of twice the rows). A group's fold follows from its rank among the groups of its size,
    which is counted in bins of groups.
    """
    spark = df.sparkSession
    counts = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    classes = [(r["n"], r["m"]) for r in counts.groupBy("n").agg(F.count("*").alias("m")).collect()]
    total = sum(m for _, m in classes)
    bins = min(MOST_BINS, total // BIN_GROUPS + 1)
    if bins > 1:
        cut = counts.where(F.col("g").isNotNull() & (F.pmod(F.xxhash64("g", F.lit("cut")), F.lit(total)) < bins)).agg(F.sort_array(F.collect_list("g")).alias("cut"))  # one row of about as many groups as bins
        counts = counts.crossJoin(F.broadcast(cut)).select("g", "n", F.size(F.filter("cut", lambda c: c <= F.col("g"))).alias("bin"))
    else:
        counts = counts.withColumn("bin", F.lit(0))
    spans = spark.createDataFrame(deal(classes, k), "n long, spans array<struct<first: long, folds: array<int>>>")
    before = F.coalesce(F.sum("m").over(W.partitionBy("n").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy("n", "bin").agg(F.count("*").alias("m")).select("n", "bin", before.alias("before")).join(spans, "n")
    rank = F.col("before") + F.row_number().over(W.partitionBy("n", "bin").orderBy("g")) - 1
    rows = counts.join(sums, ["n", "bin"]).withColumn("rank", rank).withColumn("span", F.element_at(F.filter("spans", lambda s: s["first"] <= F.col("rank")), -1))
    turn = (F.col("rank") - F.col("span.first")) % F.size("span.folds")
    return rows.select(F.col("g").alias(group), F.col("span.folds")[turn.cast("int")].alias("fold"))


def vocabulary(train: DataFrame, features: str) -> list[str]:
    """All feature names of the training rows; names that only test rows have are dropped. The driver holds them as it holds a model's coefficients."""
    return sorted(r["k"] for r in train.select(F.explode(F.map_keys(features)).alias("k")).distinct().collect())


def vectorize(df: DataFrame, features: str, names: list[str]) -> DataFrame:
    if len(names) > VOCABULARY:
        at, size = df.sparkSession.sparkContext.broadcast({n: i for i, n in enumerate(names)}), len(names)

        def sparse(m: dict | None) -> SparseVector:
            return Vectors.sparse(size, sorted((at.value[k], float(v)) for k, v in (m or {}).items() if v is not None and k in at.value))

        return df.withColumn("_raw", F.udf(sparse, VectorUDT())(features))
    cols = F.array(*(F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)) for n in names)) if names else F.array(F.lit(0.0))
    return df.withColumn("_raw", array_to_vector(cols.cast("array<double>")))


def fit_predict(train: DataFrame, test: DataFrame, features: str, label: str, model: str = "logistic") -> DataFrame:
    """test with ``p``: the probability that the label is 1. One class in training predicts itself."""
    classes = [r[0] for r in train.select(F.col(label).cast("int")).distinct().collect()]
    if len(classes) < 2:
        return test.withColumn("p", F.lit(float(classes[0]) if classes else 0.0))
    names = vocabulary(train, features)
    tr, te = (vectorize(x, features, names) for x in (train, test))
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=False, withStd=True).fit(tr)
    share = train.select(F.avg(F.col(label).cast("double"))).first()[0]
    tr = scale.transform(tr).withColumn("_y", F.col(label).cast("double")).withColumn("_w", F.when(F.col(label), 0.5 / share).otherwise(0.5 / (1 - share)))
    est = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=0.01, maxIter=30) if model == "logistic" else RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=20, maxDepth=4, seed=7)
    out = est.fit(tr).transform(scale.transform(te))
    return out.withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")


def cross_validated(df: DataFrame, features: str, label: str, group: str, k: int = 3, model: str = "logistic") -> DataFrame:
    """Out-of-fold probabilities of every row under grouped folds."""
    folds = group_folds(df, group, k).withColumnRenamed(group, "_group")
    folded = df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).select(group, *(c for c in df.columns if c != group), "fold")
    out = None
    for f in range(k):
        p = fit_predict(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), features, label, model)
        out = p if out is None else out.unionByName(p)
    return out


def threshold_table(scored: DataFrame, chosen: str, base: str, thresholds: list[float]) -> DataFrame:
    """(threshold, mean, se, coverage) of leaving the base where p exceeds the threshold."""
    each = scored.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    v = F.when(F.col("p") > F.col("threshold"), F.col(chosen)).otherwise(F.col(base)).cast("double")
    return each.groupBy("threshold").agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("se"), F.avg((F.col("p") > F.col("threshold")).cast("double")).alias("coverage"))
