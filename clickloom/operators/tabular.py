"""Tabular baseline: standardized features, class-balanced logistic regression, boosted trees."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import set_checkpoint_dir


def as_vector(df: DataFrame, array: str = "features") -> DataFrame:
    return df.withColumn(array, array_to_vector(F.col(array).cast("array<double>")))


def fit_standardizer(train: DataFrame, inputs: str = "features", output: str = "scaled") -> PipelineModel:
    """Centre and divide by the population deviation of the training rows.

    Spark's scaler divides by the sample deviation, so a constant factor follows it.
    """
    n = train.count()
    scaler = StandardScaler(inputCol=inputs, outputCol="_scaled", withMean=True, withStd=True).fit(train)
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    width = len(scaler.mean)
    fix = ElementwiseProduct(scalingVec=DenseVector([factor] * width), inputCol="_scaled", outputCol=output)
    return PipelineModel(stages=[scaler, fix])


def balanced_weights(df: DataFrame, label: str = "label", name: str = "class_weight") -> DataFrame:
    """Add ``n / (classes * rows of the class)`` per row."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, c in counts.items():
        weight = F.when(F.col(label) == F.lit(value), n / (len(counts) * c)).otherwise(weight)
    return df.withColumn(name, weight)


def fit_logistic(train: DataFrame, features: str = "scaled", label: str = "label") -> LogisticRegressionModel:
    """Class-balanced logistic regression with a unit penalty on the summed loss."""
    weighted = balanced_weights(train, label)
    n = train.count()
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="class_weight", maxIter=1000,
        regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
    ).fit(weighted)


def fit_boosted_trees(
    train: DataFrame, features: str = "features", label: str = "label", trees: int = 100, seed: int = 42
) -> GBTClassificationModel:
    set_checkpoint_dir(train.sparkSession)
    return GBTClassifier(
        featuresCol=features, labelCol=label, maxIter=trees, maxDepth=4, stepSize=0.1,
        subsamplingRate=0.8, seed=seed, checkpointInterval=10,
    ).fit(train)


def feature_importance(model: GBTClassificationModel, names: list[str], df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most important features, most important first."""
    pairs = sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))[:k]
    rows = [(i + 1, n, float(v)) for i, (n, v) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, importance double")


def score(model, df: DataFrame) -> DataFrame:
    """Add ``logit`` and ``prob`` of the positive class.

    Raw predictions of both models are symmetric around 0, so the probability gives the logit.
    """
    out = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    return out.withColumn("logit", F.log("prob") - F.log1p(-F.col("prob")))
