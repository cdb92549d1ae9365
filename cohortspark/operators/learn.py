"""Learners on pyspark.ml: fits of feature vectors, positive-unlabelled bagging, pair differences and rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable
from .statistics import quantiles


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def elastic_net(df: DataFrame, label: str, weight: str | None = None, c: float = 1.0, l1_ratio: float = 0.5, intercept: bool = True, iterations: int = 100):
    """Logistic regression with penalty 1 / (c * total weight), as Spark's loss is a mean."""
    total = df.agg(F.sum(weight) if weight else F.count("*")).first()[0] or 1
    lr = LogisticRegression(labelCol=label, elasticNetParam=l1_ratio, regParam=1.0 / (c * float(total)), standardization=False, fitIntercept=intercept, maxIter=iterations)
    return (lr.setWeightCol(weight) if weight else lr).fit(df)


def boosted(df: DataFrame, label: str, depth: int = 4, rounds: int = 20, seed: int = 7):
    return GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=0.1, seed=seed).fit(df)


def perceptron(df: DataFrame, label: str, layers: Sequence[int], seed: int = 7):
    return MultilayerPerceptronClassifier(labelCol=label, layers=list(layers), maxIter=50, seed=seed).fit(df)


def probability(model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def pu_bagging(train: DataFrame, key: str, label: str, bags: int = 5, depth: int = 6, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """A scorer: the mean over trees, each fitted on all positives and as large a hash sample of the others."""
    n = train.agg(F.avg(label)).first()[0] or 0.0
    share = min(1.0, n / max(1e-9, 1 - n))
    trees = []
    for b in range(bags):
        drawn = (F.col(label) == 1) | (F.pmod(F.xxhash64(F.lit(seed), F.lit(b), key), F.lit(1_000_000)) < int(share * 1_000_000))
        trees.append(DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=seed + b).fit(train.where(drawn)))

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("_sum", F.lit(0.0))
        for tree in trees:
            out = tree.transform(out).withColumn("_sum", F.col("_sum") + vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        return out.withColumn("score", F.col("_sum") / bags).drop("_sum")

    return score


def spy_pu(train: DataFrame, key: str, label: str, spies: float = 0.15, quantile: float = 0.05, seed: int = 7) -> Callable[[DataFrame], DataFrame]:
    """A scorer: spies, a hash sample of the positives, join the unlabelled; what scores below almost all spies counts
    as negative, and a balanced forest learns positives against these."""
    spy = (F.col(label) == 1) & (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000)) < int(spies * 1000))
    first = train.withColumn("_l", F.when(spy, 0.0).otherwise(F.col(label).cast("double")))
    scored = durable(probability(elastic_net(first, "_l"), first, "_p").withColumn("_spy", spy))
    cut = quantiles(scored.where("_spy"), {"p": F.col("_p")}, [quantile])["p"][0]
    sure = scored.where((F.col(label) == 1) | (F.col("_p") < F.lit(cut if cut is not None else 0.0))).drop("_p", "_l", "_spy")
    n = sure.agg(F.avg(label)).first()[0] or 0.5
    weighed = sure.withColumn("_w", F.when(F.col(label) == 1, 0.5 / n).otherwise(0.5 / max(1e-9, 1 - n)))
    model = RandomForestClassifier(labelCol=label, weightCol="_w", numTrees=20, maxDepth=6, seed=seed).fit(weighed)
    return lambda df: probability(model, df, "score")


def threshold_rule(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row: feature, threshold, youden of the best rule x >= threshold; candidates are quantiles of each feature.

    All candidates are tried in one pass over the rows."""
    probs = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    found = quantiles(df, {c: F.col(c) for c in features}, probs)
    rules = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.lit(q).alias("threshold")) for c in features for q in sorted({q for q in found[c] if q is not None})]
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*rules)).alias("r")).select("y", "r.*")
    hit, y = F.col("x") >= F.col("threshold"), F.col("y") == 1
    r = long.groupBy("feature", "threshold").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    youden = F.col("tp") / F.nullif("p", F.lit(0)) - F.col("fp") / F.nullif("n", F.lit(0))
    best = F.max_by(F.struct("feature", "threshold", youden.alias("youden")), F.struct(F.round(youden, 9), (-F.col("threshold")).alias("t"), "feature"))
    return r.agg(best.alias("b")).select("b.*")
