"""Every learner on a planted table, the contract's checks, and models that are saved and read."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortspark.operators import learn as L
from cohortspark.operators.adapter import KINDS, Baseline, BaselineModel


def planted(spark, n=600, curved=False, seed=1):
    """Label 1 where a rule of two features is large; a third is noise. Part of the ones are hidden among the zeros (pu)."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(3)]
        y = (x[0] * x[1] > 0) if curved else (2 * x[0] - x[1] + rng.gauss(0, 0.5) > 0.5)
        rows.append((i, x, float(y), float(y and rng.random() < 0.6), 1.0, i % 4 == 0))
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, pu double, weight double, valid boolean")
    return df.withColumn("features", array_to_vector("x")).repartition(3).cache()


def auc(rows, label="label"):
    ones, zeros = ([r.score for r in rows if r[label] == v] for v in (1.0, 0.0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_learners_find_the_rule(spark):
    df, bent = planted(spark), planted(spark, curved=True, seed=2)
    fit, held = df.where("not valid"), df.where("valid")
    assert auc(L.probability(L.elastic_net(fit, "label", "weight"), held, "score").collect()) > 0.95
    assert abs(auc(L.probability(L.elastic_net(bent.where("not valid"), "label"), bent.where("valid"), "score").collect()) - 0.5) < 0.2
    assert auc(L.probability(L.boosted(bent.where("not valid"), "label"), bent.where("valid"), "score").collect()) > 0.85
    assert auc(L.probability(L.perceptron(bent.where("not valid"), "label", [3, 12, 2]), bent.where("valid"), "score").collect()) > 0.85
    plain = auc(L.probability(L.elastic_net(fit.withColumn("l", F.col("pu")), "l"), held, "score").collect())
    for learner in (L.pu_bagging, L.spy_pu):  # from part of the ones, against all of them
        assert auc(learner(fit, "id", "pu")(held).collect()) > 0.85 and plain > 0.8


def test_layout_of_the_rows_changes_nothing(spark):
    df = planted(spark)
    one, two = ({r.id: r.score for r in L.pu_bagging(x, "id", "pu", bags=2)(df).collect()} for x in (df, df.repartition(7)))
    assert max(abs(one[k] - two[k]) for k in one) < 0.2


@pytest.mark.parametrize("kind", list(KINDS))
def test_contract(spark, kind, tmp_path):
    df = planted(spark)
    model = Baseline(kind, 3).fit(df)
    scored = model.transform(df.where("valid"))
    assert auc(scored.collect()) > 0.9 and model.selected_config() in [dict(g) for g in KINDS[kind].grid]
    model.save(str(tmp_path / "m"))
    again = BaselineModel.load(str(tmp_path / "m"))
    assert again.selected_config() == model.selected_config()
    first = {r.id: r.score for r in scored.collect()}
    assert {r.id: r.score for r in again.transform(df.where("valid")).collect()} == first


def test_contract_refuses(spark):
    df = planted(spark, 80)
    with pytest.raises(ValueError, match="without 4 finite features"):
        Baseline("logistic", 4).fit(df)
    with pytest.raises(ValueError, match="labels other than"):
        Baseline("logistic", 3).fit(df.withColumn("label", F.lit(2.0)))
    with pytest.raises(ValueError, match="both labels"):
        Baseline("logistic", 3).fit(df.withColumn("label", F.lit(1.0)))
    with pytest.raises(ValueError, match="finite"):
        Baseline("logistic", 3).fit(df.withColumn("features", array_to_vector(F.transform("x", lambda v: v / F.when(v > 0, float("inf")).otherwise(float("nan"))))))
    with pytest.raises(ValueError, match="none of"):
        Baseline("other", 3)
