"""Distributed models on pooled windows: fault probability and remaining life."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_health.operators import models
from fleet_health.operators.evaluate import (classification_metrics, rul_metrics, rul_scale,
                                             scaled_rul, with_class_weight)
from fleet_health.operators.ordering import with_place, with_test_flag
from fleet_health.schema import CODE, DYNAMIC_FEATURES, STATIC_FEATURES
from fleet_health.session import cut_lineage

INPUTS = [*DYNAMIC_FEATURES, *STATIC_FEATURES]
MIN_WINDOWS = 50


def enough_windows(windows: DataFrame, least: int = MIN_WINDOWS) -> bool:
    """Whether there are at least `least` rows, without counting them all."""
    return windows.limit(least).count() >= least


def stratified_split(windows: DataFrame, by: str = "window", seed: int = 42) -> DataFrame:
    """Add `is_test` for a fifth of each class.

    by="window" splits windows, so a machine may be on both sides; by="machine" keeps all windows
    of a machine together, with machines classed by whether any of their windows is faulty.
    """
    if by == "window":
        key = F.concat_ws("|", CODE, F.col("window_no").cast("string"))
        return with_test_flag(windows, key, "fault_label", seed)
    if by != "machine":
        raise ValueError("by must be 'window' or 'machine'")
    machines = windows.groupBy(CODE).agg(F.max("fault_label").alias("_faulty"))
    split = with_test_flag(machines, F.col(CODE), "_faulty", seed)
    return windows.join(split.select(CODE, "is_test"), CODE)


def balanced_sample(windows: DataFrame, seed: int = 42) -> DataFrame:
    """Thin the larger class to about the size of the smaller one. Opt-in: weights keep all rows."""
    n = windows.agg(*[F.count_if(F.col("fault_label") == v).alias(f"n{v}") for v in (0, 1)]).first()
    least = min(n["n0"], n["n1"])
    fractions = {v: min(1.0, least / n[f"n{v}"]) if n[f"n{v}"] else 0.0 for v in (0, 1)}
    return windows.sampleBy("fault_label", fractions, seed)


def balanced_draws(windows: DataFrame, key: Sequence[str], label: str = "fault_label", seed: int = 42) -> DataFrame:
    """As many draws with replacement as there are windows, the same number from every class.

    Each drawn window once, with `copies`, how often it was drawn. Draw i of a class takes the window
    at the place that a hash of class, i and seed names, so reruns draw alike, and the class totals are
    exact (the first classes take the remainder). Classes must be few: they are counted first.
    """
    counts = sorted((r[0], r[1]) for r in windows.where(F.col(label).isNotNull()).groupBy(label)
                    .agg(F.count(F.lit(1))).collect())
    if not counts:
        return windows.withColumn("copies", F.lit(0).cast("bigint")).where("false")
    total, classes = sum(n for _, n in counts), len(counts)
    number, which = F.floor(F.col("id") / classes), F.col("id") % classes
    pick = F.lit(None)
    size = F.lit(None).cast("bigint")
    for i, (value, n) in enumerate(counts):
        pick = F.when(which == i, F.lit(value)).otherwise(pick)
        size = F.when(which == i, F.lit(n)).otherwise(size)
    named = F.md5(F.concat_ws("|", pick.cast("string"), number.cast("string"), F.lit(str(seed))))
    place = F.conv(F.substring(named, 1, 13), 16, 10).cast("bigint") % size
    draws = (windows.sparkSession.range(total).select(pick.alias("_class"), place.alias("place"))
             .groupBy("_class", "place").agg(F.count(F.lit(1)).alias("copies")))
    placed = with_place(windows.where(F.col(label).isNotNull()), label, [F.col(k) for k in key])
    return placed.join(draws, (F.col(label) == F.col("_class")) & (placed["place"] == draws["place"])).select(
        *[placed[c] for c in windows.columns], "copies")


@dataclass
class FleetModel:
    """The fitted stages and the scale of the remaining life."""

    inputs: PipelineModel
    fault: LogisticRegressionModel
    rul: GBTRegressionModel
    rul_max: float

    def score(self, pooled: DataFrame) -> DataFrame:
        """Add `probability` and `rul` (in days)."""
        scored = self.rul.transform(self.fault.transform(self.inputs.transform(pooled)))
        return scored.select(
            *pooled.columns, vector_to_array("fault_vector")[1].alias("probability"),
            (F.col("rul_share") * F.lit(self.rul_max)).alias("rul"))

    def _columns(self) -> list[str]:
        return [c.removesuffix("_in") for c in self.inputs.stages[1].getInputCols()]

    def _fills(self) -> dict[str, float]:
        return self.inputs.stages[0].surrogateDF.first().asDict()

    def fault_table(self) -> DataFrame:
        """The classifier as one row per feature, for `models.linear_probability`."""
        return models.linear_table(SparkSession.getActiveSession(), self._columns(), self._fills(),
                                   self.fault.coefficients.toArray().tolist(), self.fault.intercept)

    def rul_table(self) -> DataFrame:
        """The regressor's nodes, for `models.tree_value`; values are shares of `rul_max`."""
        return models.tree_table(self.rul, self._columns(), self._fills(), SparkSession.getActiveSession())

    def save(self, path: str) -> None:
        """Stages under `path`; the scale goes into the configuration beside them."""
        self.inputs.write().overwrite().save(f"{path}/inputs")
        self.fault.write().overwrite().save(f"{path}/fault")
        self.rul.write().overwrite().save(f"{path}/rul")

    @staticmethod
    def load(path: str, rul_max: float) -> FleetModel:
        return FleetModel(
            PipelineModel.load(f"{path}/inputs"), LogisticRegressionModel.load(f"{path}/fault"),
            GBTRegressionModel.load(f"{path}/rul"), rul_max)


def train(windows: DataFrame, columns: Sequence[str] = tuple(INPUTS), trees: int = 10,
          iterations: int = 50) -> FleetModel:
    """Fit both models. The classifier weighs classes by inverse frequency; the regressor sees
    faulty windows only and learns remaining life as a share of the largest one. What the models read
    is written once, since each pass over it would work out the windows again."""
    # A z-score is null for a machine with one reading, a share for zero capacity.
    filled = [f"{c}_in" for c in columns]
    numeric = windows.select("fault_label", "rul_days",
                             *[F.col(c).cast("double").alias(c) for c in columns])
    inputs = Pipeline(stages=[Imputer(inputCols=list(columns), outputCols=filled),
                              VectorAssembler(inputCols=filled, outputCol="inputs")]).fit(numeric)
    ready = cut_lineage(inputs.transform(numeric).select("fault_label", "rul_days", "inputs"))
    scale = cut_lineage(rul_scale(ready))
    fault = LogisticRegression(
        featuresCol="inputs", labelCol="fault_label", weightCol="weight", maxIter=iterations,
        regParam=0.01, probabilityCol="fault_vector", rawPredictionCol="fault_raw",
        predictionCol="fault_class").fit(with_class_weight(ready))
    rul = GBTRegressor(
        featuresCol="inputs", labelCol="rul_scaled", predictionCol="rul_share", maxIter=trees,
        maxDepth=4, seed=42).fit(scaled_rul(ready.where(F.col("fault_label") == 1), scale))
    return FleetModel(inputs, fault, rul, float(scale.first()["rul_max"]))


def as_scored(scores: DataFrame) -> DataFrame:
    """Scored windows in the shape the metrics take."""
    return scores.select(
        F.col("fault_label").alias("y_true"), F.col("probability").alias("prob"),
        F.col("rul_days").alias("rul_true"), F.greatest("rul", F.lit(0.0)).alias("rul_pred"))


def evaluate(model: FleetModel, windows: DataFrame) -> DataFrame:
    """One row with all metrics of held-out windows, remaining life in days."""
    scored = as_scored(model.score(windows))
    return classification_metrics(scored).crossJoin(F.broadcast(rul_metrics(scored)))
