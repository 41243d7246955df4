"""Fitted models on a small fleet: they learn an obvious signal, and can be stored."""

import pytest
from pyspark.sql import functions as F

from fleet_health.operators import evaluate, ml, models, scoring
from fleet_health.schema import CODE, TIME


@pytest.fixture(scope="module")
def windows(spark):
    df = spark.range(300).select(
        F.format_string("TC%03d", F.col("id") % 30).alias(CODE), F.col("id").alias("window_no"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias(TIME),
        (F.col("id") % 5 == 0).cast("int").alias("fault_label"),
        F.pmod(F.hash("id"), F.lit(100)).cast("double").alias("noise"))
    life = F.col("noise") / 5 + 1
    return (df.withColumn("rul_days", F.when(F.col("fault_label") == 1, life).otherwise(-1.0))
            .withColumn("signal", F.col("fault_label") * 2 + F.col("noise") / 200)
            .withColumn("gap", F.when(F.col("window_no") % 7 != 0, F.col("noise")))).cache()


def test_train_save_score_evaluate(spark, windows, tmp_path):
    columns = ["signal", "noise", "gap"]
    split = ml.stratified_split(windows)
    model = ml.train(split.where(~F.col("is_test")), columns, trees=5, iterations=20)
    assert model.rul_max == split.where("fault_label = 1 and not is_test").agg(F.max("rul_days")).first()[0]
    metrics = ml.evaluate(model, split.where("is_test")).first()
    assert metrics["fault_f1"] > 0.95 and metrics["rul_mae"] < 3
    model.save(str(tmp_path / "best"))
    again = ml.FleetModel.load(str(tmp_path / "best"), model.rul_max)
    a, b = (sorted((r["window_no"], r["probability"], r["rul"]) for r in m.score(windows).collect())
            for m in (model, again))
    assert a == b
    predictions = scoring.as_predictions(model.score(windows.where("window_no < 30")))
    assert predictions.where("predicted_rul_days < 0").count() == 0
    assert predictions.where("is_fault_risk").count() == 6


def test_balanced_sample(windows):
    got = {r[0]: r[1] for r in ml.balanced_sample(windows).groupBy("fault_label").count().collect()}
    assert got[1] == 60 and 30 < got[0] < 100


def test_balanced_draws(spark, windows):
    drawn = ml.balanced_draws(windows, [CODE, "window_no"])
    rows = sorted((r["fault_label"], r["window_no"], r["copies"]) for r in drawn.collect())
    assert {v: sum(n for y, _, n in rows if y == v) for v in (0, 1)} == {0: 150, 1: 150}
    again = ml.balanced_draws(windows.repartition(7), [CODE, "window_no"])
    assert rows == sorted((r["fault_label"], r["window_no"], r["copies"]) for r in again.collect())
    assert 45 < sum(y == 1 for y, *_ in rows) <= 60 and drawn.columns == [*windows.columns, "copies"]
    assert ml.balanced_draws(windows.where("false"), [CODE]).count() == 0


def test_tables_score_like_the_fitted_stages(windows):
    columns = ["signal", "noise", "gap"]
    model = ml.train(windows, columns, trees=4, iterations=20)
    scored = model.score(windows).select(
        "probability", "rul", models.linear_probability(model.fault_table()).alias("p"),
        (models.tree_value(model.rul_table()) * model.rul_max).alias("r")).collect()
    assert len({r["r"] for r in scored}) > 5
    for r in scored:
        assert r["p"] == pytest.approx(r["probability"], abs=1e-9) and r["r"] == pytest.approx(r["rul"], abs=1e-9)


def test_own_model_on_arrays(spark):
    df = spark.createDataFrame([("A", [[1.0, 2.0], [3.0, 4.0]]), ("B", [[0.0, 0.0], [0.0, 1.0]])],
                               "TERMINAL_CODE string, x array<array<float>>")

    def load():
        def predict(x):
            assert x.shape[1:] == (2, 2)
            return x.mean(axis=(1, 2)) / 10, x[:, -1, -1]
        return predict

    got = {r[CODE]: (r["probability"], r["rul"]) for r in scoring.score_windows(df, load, 2, 2).collect()}
    assert got == {"A": (0.25, 4.0), "B": (pytest.approx(0.025), 1.0)}
    assert evaluate.rul_scale(spark.createDataFrame([(1, 9.0)], "fault_label int, rul_days double")).first()[0] == 9.0
