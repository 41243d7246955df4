"""CSV and JSON sources and sinks, and the scratch location."""

import datetime as dt
import glob
import json
import os

from fleet_health import session
from fleet_health.operators import evaluate
from fleet_health.schema import (CONFIG_SCHEMA, HISTORY_SCHEMA, LABELS_SCHEMA, PREDICTIONS_SCHEMA,
                                 STATIC_SCHEMA)
from fleet_health.sources import tables


def test_missing_file_is_an_empty_table(spark, tmp_path):
    assert tables.read_csv(spark, str(tmp_path / "no.csv"), LABELS_SCHEMA).count() == 0
    assert tables.read_history(spark, str(tmp_path / "no.json")).count() == 0


def test_csv_round_trip_overwrites(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = [("A", dt.datetime(2024, 1, 1, 0, 0, 0, 123456), 1, 2.5, "x"), ("B", None, 0, -1.0, None)]
    table = spark.createDataFrame(rows, LABELS_SCHEMA)
    for _ in range(2):
        tables.write_csv(table, path)
    assert sorted(tuple(r) for r in tables.read_csv(spark, path, LABELS_SCHEMA).collect()) == sorted(rows)


def test_csv_by_column_name(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text("is_fault_risk,TERMINAL_CODE,fault_probability,extra\nTrue,TC1,0.75,9\nFalse,TC2,,9\n")
    got = tables.read_csv(spark, str(file), PREDICTIONS_SCHEMA)
    assert got.schema == PREDICTIONS_SCHEMA or got.columns == PREDICTIONS_SCHEMA.names
    assert [tuple(r) for r in got.orderBy("TERMINAL_CODE").collect()] == [
        ("TC1", None, 0.75, None, True), ("TC2", None, None, None, False)]
    assert tables.read_csv(spark, str(file), STATIC_SCHEMA, absent_as_null=False).columns == ["TERMINAL_CODE"]


def test_history_json(spark, tmp_path):
    file = tmp_path / "training_history.json"
    file.write_text(json.dumps([{"epoch": 1, "train_loss": 0.9}, {"epoch": 2, "val_fault_f1": 0.5}], indent=2))
    history = tables.read_history(spark, str(file))
    assert history.schema == HISTORY_SCHEMA and history.count() == 2
    path = str(tmp_path / "out")
    tables.write_history(history, path)
    text = open(glob.glob(path + "/part-*")[0]).read()
    assert [row["epoch"] for row in json.loads(text)] == [1, 2]
    assert sorted(r["epoch"] for r in tables.read_history(spark, path).collect()) == [1, 2]


def test_config_json_of_several_models(spark, tmp_path):
    for name in ("model_a", "model_b"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "config.json").write_text(json.dumps({"seq_len": 24, "other": 1}, indent=2))
    got = tables.read_configs(spark, [str(tmp_path / "model_a"), str(tmp_path / "model_b")])
    assert {r["name"]: r["seq_len"] for r in got.collect()} == {"model_a": 24, "model_b": 24}
    config = spark.createDataFrame([(None, None, None, 48, 12, 41, 5, None, 17.5)], CONFIG_SCHEMA)
    tables.write_config(config, str(tmp_path / "model_c"))
    assert tables.read_configs(spark, str(tmp_path / "model_c")).first()["rul_max"] == 17.5


def test_report_file(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 2.0)], "fault_f1 double, rul_mae double")
    tables.write_report(evaluate.metrics_report(metrics), str(tmp_path / "report"))
    text = open(glob.glob(str(tmp_path / "report" / "part-*"))[0]).read()
    assert text.splitlines() == ["  fault_f1: 0.5000", "  RUL MAE: 2.00 days"]


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/ck" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert session.shared_dir(Session()) == "hdfs://shared/ck"
    assert session.scratch_path(Session(), "x").startswith("hdfs://shared/ck/x-")
    assert os.path.isdir(session.shared_dir(spark))
