"""End-to-end runs: train on stored tables, score the fleet with a stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_health.operators import dashboard, evaluate, features, labels, ml, scoring, sequences
from fleet_health.schema import CODE, CONFIG_SCHEMA, TIME, feature_dim
from fleet_health.session import cut_lineage
from fleet_health.sources import tables

CATEGORIES = ["PLATFORM", "ASA_VERSION"]


def train_fleet(static: DataFrame, dynamic: DataFrame, label_table: DataFrame, model_dir: str,
                length: int = sequences.LENGTH, stride: int = sequences.STRIDE, subset: int = 0,
                by: str = "window", seed: int = 42, **fit) -> DataFrame | None:
    """Train, evaluate on the held-out fifth, and store everything under `model_dir`.

    Stored are the models, the category dictionary, the configuration (with the scale of the
    remaining life), the training history and the report. Returns the one-row metrics, or None if
    there are too few windows.
    """
    spark = dynamic.sparkSession
    dynamic, static, label_table = labels.machine_subset(subset, dynamic, static, label_table)
    labels.require_unique(static, [CODE])
    labels.require_unique(label_table, [CODE, TIME])
    features.category_dictionary(static, CATEGORIES).write.mode("overwrite").parquet(
        f"{model_dir}/codes")
    registry = features.registry_features(static, spark.read.parquet(f"{model_dir}/codes"))
    windows = cut_lineage(sequences.pooled_sequences(dynamic, registry, label_table, length, stride))
    if not ml.enough_windows(windows):
        return None
    split = cut_lineage(ml.stratified_split(windows, by, seed))
    model = ml.train(split.where(~F.col("is_test")), **fit)
    model.save(f"{model_dir}/model")
    metrics = cut_lineage(ml.evaluate(model, split.where(F.col("is_test"))))
    losses = scored_losses(model, split.where(~F.col("is_test")))
    tables.write_history(history_row(losses, metrics), f"{model_dir}/training_history.json")
    tables.write_config(config_row(spark, static, length, stride, model), f"{model_dir}/config.json")
    tables.write_report(evaluate.metrics_report(metrics), f"{model_dir}/report")
    return metrics


def scored_losses(model: ml.FleetModel, windows: DataFrame) -> DataFrame:
    """Losses of training windows, remaining life as a share of its scale."""
    scored = ml.as_scored(model.score(windows))
    logit = F.log(F.greatest("prob", F.lit(1e-15))) - F.log(
        F.greatest(F.lit(1.0) - F.col("prob"), F.lit(1e-15)))
    scaled = scored.withColumns({
        "l0": F.lit(0.0), "l1": logit,
        "rul_true": F.col("rul_true") / model.rul_max, "rul_pred": F.col("rul_pred") / model.rul_max})
    return evaluate.loss_metrics(scaled)


def history_row(losses: DataFrame, metrics: DataFrame) -> DataFrame:
    """One fit is one epoch of the history."""
    return losses.crossJoin(F.broadcast(metrics)).select(
        F.lit(1).alias("epoch"), F.col("total_loss").alias("train_loss"),
        F.col("fault_loss").alias("train_fault_loss"), F.col("rul_loss").alias("train_rul_loss"),
        *[F.col(c).alias(f"val_{c}") for c in metrics.columns])


def config_row(spark: SparkSession, static: DataFrame, length: int, stride: int,
               model: ml.FleetModel) -> DataFrame:
    known = {"seq_len": length, "stride": stride, "input_dim": feature_dim(), "epochs": 1,
             "rul_max": model.rul_max}
    counted = static.agg(F.count(F.lit(1)).alias("num_machines"))
    return counted.select(*[
        (F.col(f.name) if f.name == "num_machines" else F.lit(known.get(f.name)))
        .cast(f.dataType).alias(f.name) for f in CONFIG_SCHEMA.fields])


def predict_fleet(static: DataFrame, dynamic: DataFrame, model_dir: str, length: int | None = None,
                  threshold: float = scoring.THRESHOLD) -> DataFrame:
    """Score the newest window of every machine with the stored model, riskiest first."""
    spark = dynamic.sparkSession
    config = tables.read_configs(spark, f"{model_dir}/config.json").first()
    scoring.require_registered(dynamic, static)
    registry = features.registry_features(static, spark.read.parquet(f"{model_dir}/codes"))
    model = ml.FleetModel.load(f"{model_dir}/model", config["rul_max"])
    newest = sequences.latest_pooled(dynamic, registry, length or config["seq_len"])
    return scoring.rank_by_risk(scoring.as_predictions(model.score(newest), threshold))


def fleet_report(spark: SparkSession, static, dynamic, label_table, predictions) -> dict[str, DataFrame]:
    """What the dashboard's first page shows."""
    return {"overview": dashboard.fleet_overview(spark, static, dynamic, label_table, predictions),
            "top_risk": scoring.top_risk(predictions),
            "failure_modes": labels.failure_mode_counts(label_table)}
