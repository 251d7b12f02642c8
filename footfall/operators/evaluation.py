"""Scores of fitted models, per persona: metrics, confusion matrix, percentile cut-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.joins import worked_out
from footfall.operators.ranking import percentile, running_below, value_counts, with_ranges

LOG_LOSS_FLOOR = 1e-15


def roc_auc(scored: DataFrame, by: str = "persona", y: str = "y", prob: str = "prob") -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the
    right order, ties counting half.  Null when a group has one class only."""
    counted = value_counts(scored, [by], prob, {"pos": F.col(y), "neg": 1 - F.col(y)})
    ranked = running_below(with_ranges(counted, scored, prob), [by], prob, ["pos", "neg"])
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return ranked.groupBy(by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def score_metrics(
    scored: DataFrame, by: str = "persona", y: str = "y", pred: str = "pred", prob: str = "prob"
) -> DataFrame:
    """n, null accuracy, accuracy, precision, recall, balanced accuracy, log loss, AUC."""
    actual, guess = F.col(y), F.col(pred)
    p = F.greatest(F.lit(LOG_LOSS_FLOOR), F.least(F.lit(1 - LOG_LOSS_FLOOR), F.col(prob)))
    loss = -(actual * F.log(p) + (1 - actual) * F.log(1 - p))

    def count(condition):
        return F.count_if(condition).cast("double")

    hit, miss = count((actual == 1) & (guess == 1)), count((actual == 0) & (guess == 0))
    recall = F.try_divide(hit, count(actual == 1))
    specificity = F.try_divide(miss, count(actual == 0))
    plain = scored.groupBy(by).agg(
        F.count("*").alias("n"),
        (1 - F.avg(actual)).alias("null_accuracy"),
        F.avg(F.when(actual == guess, 1.0).otherwise(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(hit, count(guess == 1)), F.lit(0.0)).alias("precision"),
        F.coalesce(recall, F.lit(0.0)).alias("recall"),
        (0.5 * (recall + specificity)).alias("bal_accuracy"),
        F.avg(loss).alias("log_loss"),
    )
    return plain.join(roc_auc(scored, by, y, prob), by, "left")


def confusion_matrix(scored: DataFrame, by: str = "persona", y: str = "y", pred: str = "pred") -> DataFrame:
    return scored.groupBy(by, y, pred).agg(F.count("*").alias("n"))


def percentile_cutoff(scored: DataFrame, q: float = 0.95, by: str = "persona", prob: str = "prob") -> DataFrame:
    """Predicts positive from each group's q-th percentile of probability upwards."""
    cut = percentile(scored, [by], prob, q).withColumnRenamed("percentile", "cutoff")
    predicted = F.when(F.col(prob) >= F.col("cutoff"), 1).otherwise(0)
    return scored.join(worked_out(cut), by, "left").withColumn("pred", predicted)
