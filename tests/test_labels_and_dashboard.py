"""Labels, registry checks, ranking and dashboard."""

import datetime as dt

import pytest

from fleet_health.operators import dashboard, labels, scoring
from fleet_health.schema import (CODE, DEGRADATION_SCHEMA, LABELS_SCHEMA, PREDICTIONS_SCHEMA, TIME)

D = dt.datetime


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "TERMINAL_CODE string, EXECUTION_TIME timestamp_ntz")


def registry(spark, codes):
    return spark.createDataFrame([(c, 1, "p", "v") for c in codes],
                                 "TERMINAL_CODE string, TERMINAL_TYPE_ID int, PLATFORM string, ASA_VERSION string")


def test_labels_from_degradation(spark):
    readings = rows(spark, [("A", D(2024, 1, 1)), ("A", D(2024, 1, 10)), ("A", D(2024, 1, 12, 6)),
                            ("A", D(2024, 2, 1)), ("B", D(2024, 1, 1)), ("C", D(2024, 1, 1))])
    bad = spark.createDataFrame([("A", "db_full", 5, D(2024, 1, 10))], DEGRADATION_SCHEMA)
    got = {(r[CODE], r[TIME]): (r["fault_label"], r["rul_days"], r["failure_mode"]) for r in
           labels.labels_from_degradation(readings, registry(spark, ["A", "B", "D"]), bad).collect()}
    assert got == {("A", D(2024, 1, 1)): (0, -1.0, "db_full"),
                   ("A", D(2024, 1, 10)): (1, 5.0, "db_full"),
                   ("A", D(2024, 1, 12, 6)): (1, 2.75, "db_full"),
                   ("A", D(2024, 2, 1)): (1, 0.0, "db_full"), ("B", D(2024, 1, 1)): (0, -1.0, "none")}


def test_label_reports(spark):
    made = spark.createDataFrame(
        [("A", D(2024, 1, i), f, 1.0, m) for i, (f, m) in
         enumerate([(1, "x"), (1, "y"), (1, "x"), (0, "x"), (1, None)], 1)], LABELS_SCHEMA)
    assert [r[:] for r in labels.failure_mode_counts(made).collect()] == [("x", 2), ("y", 1)]
    assert labels.failure_mode_map(made).first()["modes"] == {"x": 2, "y": 1}
    assert labels.fault_rate(made).first()[0] == pytest.approx(80)
    assert labels.list_labels(made, 2).count() == 2


def test_unique_keys(spark):
    good = rows(spark, [("A", D(2024, 1, 1)), ("A", D(2024, 1, 2))])
    assert labels.require_unique(good, [CODE, TIME]) is good
    with pytest.raises(ValueError):
        labels.require_unique(good, [CODE])


def test_unregistered_and_subset(spark):
    readings = rows(spark, [(c, D(2024, 1, 1)) for c in "DABCA"])
    static = registry(spark, "ACD")
    assert [r[0] for r in labels.unregistered_machines(readings, static).collect()] == ["B"]
    with pytest.raises(ValueError, match="B"):
        scoring.require_registered(readings, static)
    assert labels.registered_rows(readings, static).count() == 4
    kept = labels.machine_subset(2, readings, static)
    assert [t.count() for t in kept] == [3, 1]
    assert labels.machine_subset(0, readings, static)[0] is readings


def predictions(spark, items):
    return spark.createDataFrame([(c, D(2024, 1, 1), p, 30 * (1 - p), p > 0.5) for c, p in items],
                                 PREDICTIONS_SCHEMA)


def test_ranking_and_summary(spark):
    made = predictions(spark, [("B", 0.7), ("A", 0.7), ("C", 0.9), ("D", 0.1)])
    assert [r[CODE] for r in scoring.rank_by_risk(made).collect()] == ["C", "A", "B", "D"]
    assert [r[CODE] for r in scoring.top_risk(made, 2).collect()] == ["C", "A"]
    assert scoring.at_risk_summary(made).first()[:] == (4, 3, 75.0)
    empty = predictions(spark, [])
    assert scoring.at_risk_summary(empty).first()[:] == (0, 0, 0.0)
    assert scoring.top_risk(empty).collect() == []


def test_machine_list_and_search(spark):
    static = registry(spark, ["TC00001", "TC00012", "X%"])
    listed = dashboard.machine_list(static, predictions(spark, [("TC00001", 0.75), ("TC00012", 0.2)]))
    got = {r[CODE]: (r["probability_text"], r["rul_text"], r["status"]) for r in listed.collect()}
    assert got == {"TC00001": ("75.0%", "7.5 days", "At Risk"), "TC00012": ("20.0%", "24.0 days", "Safe"),
                   "X%": ("—", "—", "No Data")}
    for text, n in [("tc0000", 1), ("%", 1), ("", 3), (None, 3), ("_", 0)]:
        assert dashboard.machine_total(listed, text).first()[0] == n
    assert {r["status"] for r in dashboard.machine_list(static).collect()} == {"No Data"}


def test_overview_with_missing_tables(spark):
    got = dashboard.fleet_overview(spark, static=registry(spark, "AB")).first().asDict()
    assert (got["static_machines"], got["dynamic_records"], got["labels_records"],
            got["predictions_count"], got["at_risk"]) == (2, 0, 0, 0, None)


def test_model_catalog(spark):
    configs = spark.createDataFrame([("model_med", 1), ("model_quick", 2), ("saved", 3)], "name string, n int")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = dashboard.model_catalog(configs, names("model_med", "model_quick"), names("model_med", "saved"))
    assert sorted(r[:] for r in got.select("name", "has_history", "is_default").collect()) == [
        ("model_med", True, False), ("model_quick", False, True)]
    other = dashboard.model_catalog(configs, names("saved", "model_med"), names())
    assert {r["name"] for r in other.where("is_default").collect()} == {"model_med"}


def test_history(spark):
    made = spark.createDataFrame(
        [(1, 0.9, 0.0, 6.0), (2, 0.7, 0.55, 5.1), (3, 0.6, 0.72, 4.0), (4, 0.55, 0.72, None),
         (5, 0.52, 0.70, 3.8)], "epoch int, train_loss double, val_fault_f1 double, val_rul_mae double")
    assert dashboard.best_epoch(made).first()["epoch"] == 3
    assert dashboard.best_epoch(made.where("epoch = 1")).count() == 0
    assert dashboard.last_epoch(made).first()["epoch"] == 5
    assert dashboard.history_long(made).count() == 14
    batches = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (1, 3.0, 2.0, 1.0)],
                                    "epoch int, loss double, fault_loss double, rul_loss double")
    assert dashboard.epoch_losses(batches).first()[:] == (1, 2.0, 2.0, 2.0)
