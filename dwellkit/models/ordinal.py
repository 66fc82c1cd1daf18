"""Ordinal and class models on Spark ML, with the ordinal arithmetic in columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.numeric import safe_div
from dwellkit.operators.metrics import qwk_expr
from dwellkit.operators.survival import argmax


def frank_hall_probabilities(above: list[Column]) -> list[Column]:
    """Class probabilities from P(Y > k): differences, clipped to [0, 1] and renormalised."""
    raw = [1.0 - above[0], *[above[k - 1] - above[k] for k in range(1, len(above))], above[-1]]
    clipped = [F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)) for r in raw]
    total = clipped[0]
    for c in clipped[1:]:
        total = total + c
    return [F.coalesce(safe_div(c, total), F.lit(0.0)) for c in clipped]


def with_classes(df: DataFrame, above: list[Column], prefix: str = "p") -> DataFrame:
    """Add the class probabilities and their argmax as ``prediction``."""
    for k, e in enumerate(above):
        df = df.withColumn(f"_a{k}", e)
    probs = frank_hall_probabilities([F.col(f"_a{k}") for k in range(len(above))])
    for i, p in enumerate(probs):
        df = df.withColumn(f"{prefix}{i}", p)
    pred = argmax([F.col(f"{prefix}{i}") for i in range(len(probs))])
    return df.withColumn("prediction", pred.cast("double")).drop(*[f"_a{k}" for k in range(len(above))])


def preparation(features: list[str]) -> list:
    """Mean imputation and assembly as pipeline stages, so a fit sees its training frame only."""
    filled = [f"{f}__filled" for f in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="mean"),
            VectorAssembler(inputCols=filled, outputCol="features")]


@dataclass
class FrankHall:
    """K - 1 boosted binary models of Y > k."""
    features: list[str]
    n_classes: int = 3
    max_iter: int = 5
    max_depth: int = 3
    seed: int = 7
    prep: object = None
    models: list = field(default_factory=list)

    def fit(self, train: DataFrame, label: str) -> "FrankHall":
        self.prep = Pipeline(stages=preparation(self.features)).fit(train)
        rows = self.prep.transform(train).select("features", label).persist()
        try:
            self.models = [
                GBTClassifier(featuresCol="features", labelCol="_y", maxIter=self.max_iter, maxDepth=self.max_depth, seed=self.seed)
                .fit(rows.withColumn("_y", (F.col(label) > k).cast("double"))) for k in range(self.n_classes - 1)]
        finally:
            rows.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = self.prep.transform(df)
        for k, m in enumerate(self.models):
            m = m.copy().setPredictionCol(f"_d{k}").setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}")
            out = m.transform(out)
        above = [vector_to_array(f"_p{k}")[1] for k in range(len(self.models))]
        return with_classes(out, above).select(*keep, *[f"p{i}" for i in range(self.n_classes)], "prediction")

    def importances(self) -> dict[str, float]:
        """Mean of the binary models' feature importances."""
        mean = np.mean([m.featureImportances.toArray() for m in self.models], axis=0)
        return dict(zip(self.features, (float(v) for v in mean)))


def multiclass_trees(features: list[str], label: str, max_iter: int = 5, max_depth: int = 3, seed: int = 7) -> Pipeline:
    gbt = GBTClassifier(featuresCol="features", maxIter=max_iter, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[*preparation(features), OneVsRest(classifier=gbt, featuresCol="features", labelCol=label)])


class KappaEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Quadratic weighted kappa for cross-validation."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(dataset.agg(qwk_expr(F.col(self.getLabelCol()), F.col(self.getPredictionCol())).alias("k")).first()["k"])

    def isLargerBetter(self) -> bool:
        return True
