"""Metrics of scored rows (y_true 0/1, prob, rul_true, rul_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.functions import scalars as S
from fleet_health.operators.ordering import running_totals
from fleet_health.operators.scoring import THRESHOLD


def _share(part, whole):
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def classification_metrics(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0."""
    true, alarm = F.col("y_true") > 0.5, F.col("prob") > threshold
    tp, fp = F.count_if(true & alarm), F.count_if(~true & alarm)
    fn, tn = F.count_if(true & ~alarm), F.count_if(~true & ~alarm)
    return scored.agg(
        _share(tp + tn, tp + tn + fp + fn).alias("fault_accuracy"),
        _share(tp, tp + fp).alias("fault_precision"),
        _share(tp, tp + fn).alias("fault_recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("fault_f1"))


def rul_metrics(scored: DataFrame, rul_max: float = 1.0) -> DataFrame:
    """Mean absolute and root mean square error of faulty rows, in days; 0 without faulty rows."""
    off = (F.col("rul_true") - F.col("rul_pred")) * F.lit(float(rul_max))
    return scored.where(F.col("y_true") > 0.5).agg(
        F.coalesce(F.avg(F.abs(off)), F.lit(0.0)).alias("rul_mae"),
        F.coalesce(F.sqrt(F.avg(off * off)), F.lit(0.0)).alias("rul_rmse"))


def confusion_counts(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: tn, fp, fn, tp, zeros included."""
    true, alarm = F.col("y_true") > 0.5, F.col("prob") > threshold
    return scored.agg(F.count_if(~true & ~alarm).alias("tn"), F.count_if(~true & alarm).alias("fp"),
                      F.count_if(true & ~alarm).alias("fn"), F.count_if(true & alarm).alias("tp"))


def confusion_matrix(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Two rows, always: actual, predicted_0, predicted_1."""
    return confusion_counts(scored, threshold).select(F.inline(F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"),
                 F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"),
                 F.col("tp").alias("predicted_1")))))


def confusion_long(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Four rows in the order tn, fp, fn, tp."""
    return confusion_counts(scored, threshold).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("cell"), F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                 F.col(name).alias("n"))
        for i, (name, a, p) in enumerate([("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)])])))


def _score_points(scored: DataFrame) -> DataFrame:
    """Equal scores are one point of the curve; counted before anything is ordered."""
    true = F.col("y_true") > 0.5
    points = scored.groupBy(F.col("prob").alias("score")).agg(
        F.count_if(true).alias("pos"), F.count_if(~true).alias("neg"))
    return running_totals(points, "score", ["pos", "neg"])


def roc_curve(scored: DataFrame) -> DataFrame:
    """Points by falling score, and the start (0, 0) with a null score."""
    points = _score_points(scored).select(
        "score", F.try_divide(F.col("cum_neg").cast("double"), "total_neg").alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), "total_pos").alias("tpr"))
    start = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids; null if only one class occurs.

    Each point knows the true positives before and after it, so no neighbour row is needed.
    """
    strip = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    area = F.try_divide(F.sum(strip), F.first("total_pos").cast("double") * F.first("total_neg"))
    return _score_points(scored).agg(area.alias("auc"))


def rul_pairs(scored: DataFrame) -> DataFrame:
    """Actual and predicted remaining life of faulty rows, each with the range of both."""
    faulty = scored.where(F.col("y_true") > 0.5).select("rul_true", "rul_pred")
    span = faulty.agg(
        F.least(F.min("rul_true"), F.min("rul_pred")).alias("axis_min"),
        F.greatest(F.max("rul_true"), F.max("rul_pred")).alias("axis_max"))
    return faulty.crossJoin(F.broadcast(span))


def loss_metrics(scored: DataFrame, pos_weight: float | None = None, rul_alpha: float = 1.0
                 ) -> DataFrame:
    """Cross-entropy of two logits (l0, l1), masked squared error, and their combination."""
    # log(1 + e^x) without overflow.
    margin = F.when(F.col("y_true") > 0.5, F.col("l0") - F.col("l1")).otherwise(
        F.col("l1") - F.col("l0"))
    nll = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    weight = F.when(F.col("y_true") > 0.5, F.lit(1.0 if pos_weight is None else float(pos_weight))
                    ).otherwise(F.lit(1.0))
    gap = F.col("rul_pred") - F.col("rul_true")
    losses = scored.agg(
        F.try_divide(F.sum(weight * nll), F.sum(weight)).alias("fault_loss"),
        F.coalesce(F.avg(F.when(F.col("y_true") > 0.5, gap * gap)), F.lit(0.0)).alias("rul_loss"))
    return losses.withColumn("total_loss",
                             F.col("fault_loss") + F.col("rul_loss") * F.lit(float(rul_alpha)))


def rul_summary(windows: DataFrame) -> DataFrame:
    """Counts of all and faulty windows, and mean and population deviation of the latter's rul."""
    faulty = F.when(F.col("fault_label") > 0.5, F.col("rul_days"))
    return windows.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("fault_label") > 0.5).alias("n_faulty"),
        F.avg(faulty).alias("rul_mean"), F.stddev_pop(faulty).alias("rul_std"))


def rul_scale(windows: DataFrame) -> DataFrame:
    """One row: the largest remaining life of faulty windows, at least 1."""
    faulty = F.when(F.col("fault_label") > 0.5, F.col("rul_days"))
    return windows.agg(F.greatest(F.coalesce(F.max(faulty), F.lit(1.0)), F.lit(1.0))
                       .alias("rul_max"))


def scaled_rul(windows: DataFrame, scale: DataFrame) -> DataFrame:
    """Add `rul_scaled`, the remaining life as a share of the scale."""
    return (windows.crossJoin(F.broadcast(scale))
            .withColumn("rul_scaled", F.col("rul_days") / F.col("rul_max")))


def class_weights(windows: DataFrame, label: str = "fault_label") -> DataFrame:
    """Count and inverse-frequency weight per class."""
    counts = windows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.lit(1.0) / F.col("n"))


def with_class_weight(windows: DataFrame, label: str = "fault_label") -> DataFrame:
    """Add `weight` of the row's class. Two classes, so the weights come as one broadcast row."""
    one = windows.agg(*[F.count_if(F.col(label) == v).alias(f"_n{v}") for v in (0, 1)])
    n = F.when(F.col(label) == 1, F.col("_n1")).otherwise(F.col("_n0"))
    return (windows.crossJoin(F.broadcast(one))
            .withColumn("weight", F.try_divide(F.lit(1.0), n)).drop("_n0", "_n1"))


# Lines of the report (metric, section, label, decimals, unit).
REPORT_LINES = [
    ("fault_accuracy", "FAULT DETECTION METRICS", "fault_accuracy", 4, ""),
    ("fault_precision", "FAULT DETECTION METRICS", "fault_precision", 4, ""),
    ("fault_recall", "FAULT DETECTION METRICS", "fault_recall", 4, ""),
    ("fault_f1", "FAULT DETECTION METRICS", "fault_f1", 4, ""),
    ("rul_mae", "RUL PREDICTION METRICS", "RUL MAE", 2, " days"),
    ("rul_rmse", "RUL PREDICTION METRICS", "RUL RMSE", 2, " days"),
]


def metrics_report(metrics: DataFrame) -> DataFrame:
    """One line per metric the one-row table has, in report order."""
    lines = [F.struct(F.lit(i).alias("line"), F.lit(section).alias("section"),
                      F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"),
                      F.concat(F.lit(f"  {label}: "), S.fixed(F.col(name).cast("double"), digits),
                               F.lit(unit)).alias("text"))
             for i, (name, section, label, digits, unit) in enumerate(REPORT_LINES)
             if name in metrics.columns]
    return metrics.select(F.inline(F.array(*lines))).where(F.col("value").isNotNull())


def _correlation(x, y):
    """As `corr`, but null instead of an error where one of the two is constant."""
    y = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_importance(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Absolute correlation of each feature with the label; 0 for a constant feature."""
    y = F.col(label).cast("double")
    one = rows.agg(*[_correlation(F.col(f).cast("double"), y).alias(f) for f in features])
    pairs = [F.struct(F.lit(f).alias("feature"),
                      F.coalesce(F.abs(F.col(f)), F.lit(0.0)).alias("score")) for f in features]
    return one.select(F.inline(F.array(*pairs)))


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("score"), "feature").limit(k)
