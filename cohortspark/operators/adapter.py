"""One contract for all baselines: an Estimator that checks its input, tries a grid of settings and keeps the best on
validation rows, and a Model that adds a score to every row, tells its setting, and can be saved and read again."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import auroc


@dataclass(frozen=True)
class Kind:
    """A learner: its grid, how a setting makes an estimator (of features' width and the rows' total weight), and the
    class that reads its fitted model."""

    grid: tuple[Mapping[str, Any], ...]
    make: Callable[[Mapping[str, Any], int, float], Any]
    reader: type


KINDS = {
    "logistic": Kind(
        tuple({"c": c} for c in (0.1, 1.0, 10.0)),
        lambda s, width, total: LogisticRegression(elasticNetParam=0.5, regParam=1.0 / (s["c"] * total), standardization=False, weightCol="weight"),
        LogisticRegressionModel,
    ),
    "boosted": Kind(tuple({"depth": d} for d in (2, 4)), lambda s, width, total: GBTClassifier(maxDepth=s["depth"], maxIter=10, stepSize=0.2, weightCol="weight", seed=7), GBTClassificationModel),
    "forest": Kind(tuple({"depth": d} for d in (4, 8)), lambda s, width, total: RandomForestClassifier(maxDepth=s["depth"], numTrees=20, weightCol="weight", seed=7), RandomForestClassificationModel),
    "perceptron": Kind(({"hidden": 8}, {"hidden": 16}), lambda s, width, total: MultilayerPerceptronClassifier(layers=[width, s["hidden"], 2], maxIter=50, seed=7), MultilayerPerceptronClassificationModel),
}


def check_rows(df: DataFrame, width: int) -> None:
    """Raises ValueError unless all features are vectors of `width` finite numbers, labels are 0 or 1, and both are there."""
    x = vector_to_array("features")
    bad = F.col("features").isNull() | (F.size(x) != width) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = df.agg(F.count_if(bad).alias("features"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("labels"), F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros")).first()
    if found.features or found.labels:
        raise ValueError(f"{found.features} rows without {width} finite features, {found.labels} labels other than 0 and 1")
    if not found.ones or not found.zeros:
        raise ValueError("both labels are needed")


class Baseline(Estimator):
    """Fits on rows with features, label (0 means unlabelled) and weight; rows with `valid` choose the setting by AUROC,
    of equal ones the first, and are not trained on."""

    def __init__(self, kind: str, width: int) -> None:
        super().__init__()
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
        self.kind, self.width = kind, width

    def _fit(self, dataset: DataFrame) -> BaselineModel:
        train, valid = dataset.where("not valid"), dataset.where("valid")
        check_rows(train, self.width)
        check_rows(valid, self.width)
        total = float(train.agg(F.sum("weight")).first()[0])
        best: tuple[float, BaselineModel] | None = None
        for setting in KINDS[self.kind].grid:
            model = BaselineModel(self.kind, self.width, dict(setting), KINDS[self.kind].make(setting, self.width, total).fit(train))
            score = round(auroc(model.transform(valid).withColumn("y", F.col("label").cast("int")), "score", "y").first()["auroc"], 9)
            if best is None or score > best[0]:
                best = score, model
        return best[1]


class BaselineModel(Model):
    """Adds score, the probability of label 1, to every row; a row whose score is null or not finite raises."""

    def __init__(self, kind: str, width: int, setting: dict[str, Any], inner: Model) -> None:
        super().__init__()
        self.kind, self.width, self.setting, self.inner = kind, width, setting, inner

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = vector_to_array("probability")[1]
        checked = F.when(score.isNull() | F.isnan(score), F.raise_error(F.lit("a score is missing")).cast("double")).otherwise(score)
        return self.inner.transform(dataset).withColumn("score", checked).drop("probability", "rawPrediction", "prediction")

    def selected_config(self) -> dict[str, Any]:
        return dict(self.setting)

    def save(self, path: str) -> None:
        """Writes the model and its setting to a folder that must not exist."""
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps({"kind": self.kind, "width": self.width, "setting": self.setting}),)], "value string").coalesce(1).write.text(f"{path}/setting")
        self.inner.save(f"{path}/model")

    @staticmethod
    def load(path: str) -> BaselineModel:
        told = json.loads(SparkSession.active().read.text(f"{path}/setting").first()[0])
        return BaselineModel(told["kind"], told["width"], told["setting"], KINDS[told["kind"]].reader.load(f"{path}/model"))
