"""The command line, end to end, on a small raw file."""

import json
import glob

import numpy as np
import pytest

from fleet_health.__main__ import main
from fleet_health.operators import labels
from fleet_health.plans import runs
from fleet_health.schema import (CODE, DYNAMIC_SCHEMA, LABELS_SCHEMA, PREDICTIONS_SCHEMA, STATIC_SCHEMA)
from fleet_health.sources import tables

HEADER = ("UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],"
          "Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF\n")


def raw(n):
    rng = np.random.default_rng(0)
    for i in range(1, n + 1):
        bad = int(i % 4 == 0)
        yield (f"{i},P{i},{'LMH'[i % 3]},{298 + rng.random():.1f},{308 + rng.random():.1f},"
               f"{1300 + int(rng.integers(300)) - 200 * bad},{40 + 30 * bad + rng.random():.1f},"
               f"{int(rng.integers(200))},{bad},{bad},0,0,0,0\n")


def test_adapt_train_predict_report(spark, tmp_path, capsys):
    file, folder, model, out = (str(tmp_path / n) for n in ("raw.csv", "tables", "model", "predictions"))
    (tmp_path / "raw.csv").write_text(HEADER + "".join(raw(40)))
    main(["adapt", "--dataset", "ai4i2020", "--input", file, "--output", folder])
    main(["train", "--tables", folder, "--model-dir", model, "--seq-len", "12", "--stride", "4"])
    main(["predict", "--tables", folder, "--model-dir", model, "--output", out])
    main(["report", "--tables", folder, "--predictions", out])
    assert "static_machines" in capsys.readouterr().out
    made = tables.read_csv(spark, out, PREDICTIONS_SCHEMA).collect()
    assert len(made) == 40
    assert {r[CODE] for r in made if r["is_fault_risk"]} == {f"TC{i:05d}" for i in range(4, 41, 4)}
    # In days: the ramp ends at half a day, and its largest window target is known.
    config = tables.read_configs(spark, f"{model}/config.json").first()
    assert config["num_machines"] == 40 and 5 < config["rul_max"] <= 15 and config["seq_len"] == 12
    assert all(0 <= r["predicted_rul_days"] < 15 for r in made)
    history = json.loads(open(glob.glob(f"{model}/training_history.json/part-*")[0]).read())
    assert len(history) == 1 and history[0]["val_fault_f1"] > 0.9
    text = open(glob.glob(f"{model}/report/part-*")[0]).read()
    assert text.startswith("  fault_accuracy: ") and " days" in text


def test_guards(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(HEADER + "".join(raw(4)))
    main(["adapt", "--dataset", "ai4i2020", "--input", str(tmp_path / "raw.csv"), "--output", str(tmp_path / "t")])
    static, dynamic, label_table = (tables.read_csv(spark, str(tmp_path / "t" / n), s) for n, s in [
        ("static_data", STATIC_SCHEMA), ("dynamic_data", DYNAMIC_SCHEMA), ("labels", LABELS_SCHEMA)])
    assert runs.train_fleet(static, dynamic, label_table, str(tmp_path / "m"), 12, 4) is None
    with pytest.raises(ValueError, match="duplicate keys"):
        runs.train_fleet(static.union(static), dynamic, label_table, str(tmp_path / "m"), 12, 4)
    some = labels.machine_subset(2, dynamic, static)
    assert some[1].count() == 2
