"""Command line: adapt a dataset, train, predict, report.

    python -m fleet_health adapt --dataset ai4i2020 --input ai4i2020.csv --output tables
    python -m fleet_health train --tables tables --model-dir model --seq-len 12 --stride 4
    python -m fleet_health predict --tables tables --model-dir model --output predictions
    python -m fleet_health report --tables tables --predictions predictions

Tables are CSV files or folders named static_data, dynamic_data and labels (with or without .csv).
"""

from __future__ import annotations

import argparse

from fleet_health.operators import scoring
from fleet_health.plans import runs
from fleet_health.schema import DYNAMIC_SCHEMA, LABELS_SCHEMA, PREDICTIONS_SCHEMA, STATIC_SCHEMA
from fleet_health.session import build_session
from fleet_health.sources import datasets, tables

SCHEMAS = {"static_data": STATIC_SCHEMA, "dynamic_data": DYNAMIC_SCHEMA, "labels": LABELS_SCHEMA}


def load(spark, folder: str, name: str):
    """`name`.csv if it has rows, else `name`."""
    table = tables.read_csv(spark, f"{folder}/{name}.csv", SCHEMAS[name])
    return table if table.limit(1).count() else tables.read_csv(spark, f"{folder}/{name}", SCHEMAS[name])


def adapt(spark, args) -> None:
    for name, table in zip(SCHEMAS, datasets.load_dataset(spark, args.dataset, args.input)):
        tables.write_csv(table, f"{args.output}/{name}")


def train(spark, args) -> None:
    static, dynamic, labels = (load(spark, args.tables, name) for name in SCHEMAS)
    metrics = runs.train_fleet(static, dynamic, labels, args.model_dir, args.seq_len, args.stride,
                                   args.subset, args.split_by)
    if metrics is None:
        print("Too few windows.")
    else:
        metrics.show(truncate=False)


def predict(spark, args) -> None:
    static, dynamic = (load(spark, args.tables, name) for name in ("static_data", "dynamic_data"))
    made = runs.predict_fleet(static, dynamic, args.model_dir, args.seq_len)
    tables.write_csv(made, args.output)
    stored = tables.read_csv(spark, args.output, PREDICTIONS_SCHEMA)
    scoring.at_risk_summary(stored).show()
    scoring.top_risk(stored).show(truncate=False)


def report(spark, args) -> None:
    static, dynamic, labels = (load(spark, args.tables, name) for name in SCHEMAS)
    predictions = tables.read_csv(spark, args.predictions, PREDICTIONS_SCHEMA)
    for table in runs.fleet_report(spark, static, dynamic, labels, predictions).values():
        table.show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fleet_health")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("adapt")
    one.add_argument("--dataset", required=True, choices=sorted(datasets.LOADERS))
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    one.set_defaults(run=adapt)
    one = commands.add_parser("train")
    one.add_argument("--tables", required=True)
    one.add_argument("--model-dir", required=True)
    one.add_argument("--seq-len", type=int, default=48)
    one.add_argument("--stride", type=int, default=12)
    one.add_argument("--subset", type=int, default=0, help="first N machines only (0 = all)")
    one.add_argument("--split-by", choices=["window", "machine"], default="window")
    one.set_defaults(run=train)
    one = commands.add_parser("predict")
    one.add_argument("--tables", required=True)
    one.add_argument("--model-dir", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--seq-len", type=int, default=None, help="default: as trained")
    one.set_defaults(run=predict)
    one = commands.add_parser("report")
    one.add_argument("--tables", required=True)
    one.add_argument("--predictions", required=True)
    one.set_defaults(run=report)
    return top


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
