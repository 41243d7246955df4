"""What the fleet dashboard shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.functions import scalars as S
from fleet_health.schema import CODE


def fleet_overview(spark, static: DataFrame | None = None, dynamic: DataFrame | None = None,
                   labels: DataFrame | None = None, predictions: DataFrame | None = None
                   ) -> DataFrame:
    """One row of counts and rates; a missing table counts as empty."""
    parts = []
    for name, table in [("static_machines", static), ("dynamic_records", dynamic)]:
        if table is not None:
            parts.append(table.agg(F.count(F.lit(1)).alias(name)))
        else:
            parts.append(spark.range(1).select(F.lit(0).cast("bigint").alias(name)))
    if labels is not None:
        parts.append(labels.agg(
            F.count(F.lit(1)).alias("labels_records"),
            F.sum("fault_label").cast("bigint").alias("total_faults"),
            F.round(F.avg("fault_label") * 100, 2).alias("fault_rate")))
    else:
        parts.append(spark.range(1).select(
            F.lit(0).cast("bigint").alias("labels_records"),
            F.lit(None).cast("bigint").alias("total_faults"),
            F.lit(None).cast("double").alias("fault_rate")))
    if predictions is not None:
        parts.append(predictions.agg(
            F.count(F.lit(1)).alias("predictions_count"),
            F.count_if(F.col("is_fault_risk")).alias("at_risk"),
            F.round(F.avg("fault_probability"), 4).alias("avg_fault_prob")))
    else:
        parts.append(spark.range(1).select(
            F.lit(0).cast("bigint").alias("predictions_count"),
            F.lit(None).cast("bigint").alias("at_risk"),
            F.lit(None).cast("double").alias("avg_fault_prob")))
    # Every part is one row.
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def machine_list(static: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Registry with the last prediction (or nulls) and display texts."""
    if predictions is None:
        joined = static.withColumns({
            "fault_probability": F.lit(None).cast("double"),
            "predicted_rul_days": F.lit(None).cast("double"),
            "is_fault_risk": F.lit(None).cast("boolean")})
    else:
        joined = static.join(predictions.select(
            CODE, F.round("fault_probability", 4).alias("fault_probability"),
            F.round("predicted_rul_days", 2).alias("predicted_rul_days"), "is_fault_risk"),
            CODE, "left")
    return joined.select(
        CODE, "TERMINAL_TYPE_ID", S.or_dash("PLATFORM").alias("platform"),
        S.or_dash("ASA_VERSION").alias("version"), "fault_probability", "predicted_rul_days",
        "is_fault_risk", S.percent_text("fault_probability").alias("probability_text"),
        S.days_text("predicted_rul_days").alias("rul_text"),
        S.risk_status("is_fault_risk").alias("status"))


def machine_search(machines: DataFrame, search: str | None) -> DataFrame:
    """Machines whose code contains the text, in any case; no text means all."""
    return machines.where(S.contains_ignoring_case(CODE, search)) if search else machines


def machine_total(machines: DataFrame, search: str | None) -> DataFrame:
    return machine_search(machines, search).agg(F.count(F.lit(1)).alias("total"))


def model_catalog(configs: DataFrame, with_weights: DataFrame, with_history: DataFrame
                  ) -> DataFrame:
    """Models that have both a configuration and saved weights, with the default marked."""
    listed = (configs.join(with_weights.select("name").distinct(), "name", "left_semi")
              .join(with_history.select("name", F.lit(True).alias("_h")).distinct(), "name", "left")
              .withColumn("has_history", F.coalesce("_h", F.lit(False))).drop("_h"))
    default = listed.agg(F.coalesce(
        F.max(F.when(F.col("name") == "model_quick", F.col("name"))), F.min("name"))
        .alias("_default"))
    return (listed.crossJoin(F.broadcast(default))
            .withColumn("is_default", F.col("name") == F.col("_default")).drop("_default"))


# --- training history -------------------------------------------------------------------------

def epoch_losses(batches: DataFrame) -> DataFrame:
    """Mean of the batch losses per epoch, whatever the batch sizes."""
    return batches.groupBy("epoch").agg(
        F.avg("loss").alias("train_loss"), F.avg("fault_loss").alias("train_fault_loss"),
        F.avg("rul_loss").alias("train_rul_loss"))


def last_epoch(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("epoch")).limit(1)


def best_epoch(history: DataFrame) -> DataFrame:
    """The earliest epoch with the best F1; none if F1 never rises above 0."""
    return (history.where(F.col("val_fault_f1") > 0)
            .orderBy(F.desc("val_fault_f1"), "epoch").limit(1))


def history_long(history: DataFrame) -> DataFrame:
    """(epoch, metric, value), without missing values."""
    metrics = [c for c in history.columns if c != "epoch"]
    return (history.select("epoch", *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(["epoch"], metrics, "metric", "value").where(F.col("value").isNotNull()))
