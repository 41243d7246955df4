"""Scoring the fleet: probabilities, risk ranking and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.functions import scalars as S
from fleet_health.operators import series as R
from fleet_health.operators.labels import unregistered_machines
from fleet_health.operators.models import PREDICTED
from fleet_health.operators.sequences import latest_parts
from fleet_health.schema import CODE, TIME

THRESHOLD = 0.5


def as_predictions(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(probability, rul) per machine -> the predictions table; the flag uses the exact value."""
    return scores.select(
        CODE, TIME, F.round("probability", 4).alias("fault_probability"),
        F.round(S.at_least_zero("rul"), 2).alias("predicted_rul_days"),
        (F.col("probability") > threshold).alias("is_fault_risk"))


def fault_binary(scored: DataFrame, prob: str = "prob", threshold: float = THRESHOLD) -> DataFrame:
    return scored.withColumn("fault_binary", S.flag(F.col(prob) > threshold))


def linear_scores(rows: DataFrame, static: DataFrame, length: int = 24, tie: Sequence[str] = (),
                  weights: tuple[float, float, float] = (0.05, -0.03, -2.0),
                  max_rows: int = R.MAX_ROWS) -> DataFrame:
    """Predictions of a fixed linear score on disk use and link stability of the newest readings.

    Stands in for a trained model where results must be reproducible in plain SQL. Unregistered
    machines are left out; `unregistered_machines` lists them.
    """
    slim = rows.select(CODE, TIME, *tie, "HOME_USED_MB", "NETWORK_LINK")
    parts = R.split_series(slim, max(1, length - 1), "NETWORK_LINK", tie, max_rows)
    parts = R.with_positions(parts, "NETWORK_LINK", tie)
    newest = latest_parts(parts, length, tie).groupBy(CODE, R.SEGMENT).agg(
        F.max(TIME).alias(TIME), F.avg("HOME_USED_MB").alias("_used"),
        F.max_by(R.RUN, R.ROW).alias("_stable")).join(static.select(CODE), CODE, "left_semi")
    used, stable, constant = weights
    scores = newest.withColumn("probability", S.logistic(
        F.col("_used") * used + F.col("_stable") * stable + constant))
    return as_predictions(scores.withColumn("rul", (F.lit(1.0) - F.col("probability")) * 30))


def score_windows(windows: DataFrame, make_predict: Callable, length: int, features: int,
                  batch: int = 256) -> DataFrame:
    """Apply a user's own model to windows with an array column `x`; adds `probability` and `rul`.

    `make_predict` is called once per Python worker, where it may load a model. It returns a function
    from a NumPy array of float32 (windows, length, features) to (probability, rul). Arrays travel as
    one flat tensor column in Arrow batches; all other columns stay in the JVM.
    """
    def made():
        import numpy as np

        predict = make_predict()

        def run(x):
            probability, rul = predict(x)
            return {"probability": np.asarray(probability, "float64"), "rul": np.asarray(rul, "float64")}

        return run

    score = predict_batch_udf(made, return_type=PREDICTED, batch_size=batch, input_tensor_shapes=[[length, features]])
    scored = windows.withColumn("_scored", score(F.flatten("x")))
    return scored.select(*[c for c in windows.columns if c != "x"], "_scored.probability", "_scored.rul")


def require_registered(rows: DataFrame, static: DataFrame) -> None:
    """Raise if a reporting machine has no registry row, naming a few of them."""
    missing = [r[0] for r in unregistered_machines(rows, static).limit(5).collect()]
    if missing:
        raise ValueError(f"machines without registry row, e.g. {missing}")


def rank_by_risk(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy(F.desc("fault_probability"), CODE)


def top_risk(predictions: DataFrame, k: int = 10) -> DataFrame:
    return rank_by_risk(predictions).limit(k)


def at_risk_summary(predictions: DataFrame) -> DataFrame:
    n, risky = F.count(F.lit(1)), F.count_if(F.col("is_fault_risk"))
    return predictions.agg(
        n.alias("predictions_count"), risky.alias("at_risk"),
        F.coalesce(F.round(F.try_divide(risky * F.lit(100.0), n), 1), F.lit(0.0))
        .alias("at_risk_pct"))
