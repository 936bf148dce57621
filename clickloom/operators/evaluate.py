"""Metrics over scored tables."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import focal_loss_term, log_loss_term


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half, as one row ``(n_pos, n_neg, auc)``.

    NaN scores are dropped; 0.0 where a class is absent. Scores are grouped, range-partitioned and
    summed per partition by the evaluator, so no global sort lands in one task. Runs when called.
    """
    rows = df.select(F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y"))
    rows = rows.filter("_s is not null and not isnan(_s)")
    # equal scores are one row from here on, which also evens out a very frequent score
    counts = rows.agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_y") == 0).alias("n")).first()
    area = 0.0
    if counts["p"] and counts["n"]:
        grouped = rows.groupBy("_s", "_y").agg(F.count(F.lit(1)).cast("double").alias("_w"))
        evaluator = BinaryClassificationEvaluator(
            rawPredictionCol="_s", labelCol="_y", weightCol="_w", metricName="areaUnderROC", numBins=0
        )
        area = float(evaluator.evaluate(grouped))
    return df.sparkSession.createDataFrame(
        [(counts["p"], counts["n"], area)], "n_pos bigint, n_neg bigint, auc double"
    )


def log_loss(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Mean cross entropy from logits, NaN dropped; infinity where nothing is left."""
    rows = df.filter(F.col(logit).isNotNull() & ~F.isnan(logit))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(log_loss_term(logit, label)), F.lit(float("inf"))).alias("log_loss"),
    )


def focal_loss(
    df: DataFrame, logit: str, label: str, alpha: float = 0.1, gamma: float = 2.0, reduction: str = "mean"
) -> DataFrame:
    """Focal loss of a scored table: one row for ``mean`` and ``sum``, a ``focal_loss`` per row for ``none``."""
    term = focal_loss_term(logit, label, alpha, gamma)
    if reduction == "none":
        return df.withColumn("focal_loss", term)
    return df.agg((F.avg if reduction == "mean" else F.sum)(term).alias("focal_loss"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined. Works on the confusion counts."""
    cells = df.groupBy(F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    roles = F.array(
        F.struct(F.col("_y").alias("class"), F.lit("true").alias("role")),
        F.struct(F.col("_p").alias("class"), F.lit("said").alias("role")),
    )
    per_class = (
        cells.select("_y", "_p", "_n", F.inline(roles))
        .groupBy("class")
        .agg(
            F.coalesce(F.sum(F.when(F.col("role") == "true", F.col("_n"))), F.lit(0)).alias("support"),
            F.coalesce(F.sum(F.when(F.col("role") == "said", F.col("_n"))), F.lit(0)).alias("predicted"),
            F.coalesce(
                F.sum(F.when((F.col("role") == "true") & (F.col("_y") == F.col("_p")), F.col("_n"))), F.lit(0)
            ).alias("hits"),
        )
    )
    one = F.lit(1)
    return per_class.select(
        "class",
        (F.col("hits") / F.greatest("predicted", one)).alias("precision"),
        (F.col("hits") / F.greatest("support", one)).alias("recall"),
        (2 * F.col("hits") / F.greatest(F.col("predicted") + F.col("support"), one)).alias("f1"),
        "support",
    )


def last_prediction(df: DataFrame, user: str, order: list[str], score: str) -> DataFrame:
    """The score of each user's last row. An aggregation, so rows of one user combine on the map side."""
    return df.groupBy(user).agg(F.max_by(score, F.struct(*order)).alias(score))
