"""Registered queries: (spark, folder of parquet tables) -> DataFrame, always over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_health.operators import (dashboard, evaluate, features, labels, ml, models, scoring, sequences)
from fleet_health.plans import views as V
from fleet_health.schema import CODE, DYNAMIC_FEATURES, DYNAMIC_SCHEMA, STATIC_FEATURES, TIME
from fleet_health.session import cut_lineage, scratch_path
from fleet_health.sources import datasets, tables

LENGTH, STRIDE = 24, 8
KEY = [CODE, TIME]
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


def _round(name: str, digits: int = 6):
    """Rounded for comparison; adding 0.0 turns a negative zero into zero."""
    return F.expr(f"round(cast({name} as double), {digits}) + 0.0D as {name}")


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


# --- telemetry features -----------------------------------------------------------------------

@query
def ticket_number_int(spark, sf):
    return features.with_ticket_number(V.dynamic(spark, sf)).select(*KEY, "LAST_TKT_NUMBER_int")


@query
def cyclic_time(spark, sf):
    return features.with_cyclic_time(V.dynamic(spark, sf)).select(
        *KEY, *[_round(c) for c in ("hour_sin", "hour_cos", "day_of_week_sin",
                                    "day_of_week_cos")])


@query
def guarded_ratios(spark, sf):
    return features.with_ratios(V.dynamic(spark, sf)).select(
        *KEY, _round("db_free_pct"), _round("ticket_volume_ratio"))


@query
def uptime_hours(spark, sf):
    return features.with_uptime(V.dynamic(spark, sf)).select(
        *KEY, *[_round(c) for c in ("os_uptime_hours", "db_uptime_hours", "log_exist_hours")])


@query
def disk_usage_pct(spark, sf):
    return features.with_disk_usage(V.dynamic(spark, sf), V.static(spark, sf)).select(
        *KEY, _round("home_used_pct"), _round("home1_used_pct"))


ROLLING = [c for c in DYNAMIC_FEATURES if "_roll_" in c]


@query
def rolling_features(spark, sf):
    return features.rolling_features(V.dynamic(spark, sf)).select(
        *KEY, *[_round(c, 7 if "mean" in c else 6) for c in ROLLING])


@query
def diff_features(spark, sf):
    return features.difference_features(V.dynamic(spark, sf)).select(
        *KEY, _round("home_used_diff"), _round("db_free_diff"))


@query
def netlink_stable(spark, sf):
    return features.link_stability(V.dynamic(spark, sf)).select(*KEY, _long("netlink_stable_hours"))


@query
def zscores(spark, sf):
    return features.zscore_features(V.dynamic(spark, sf)).select(
        *KEY, _round("home_used_zscore"), _round("db_free_zscore"))


@query
def features_all(spark, sf):
    made = features.telemetry_features(V.dynamic(spark, sf), V.static(spark, sf))
    return features.feature_vector(made).select(
        *KEY, *[_round(c, 7 if "roll_mean" in c else 6) for c in DYNAMIC_FEATURES])


# --- registry ---------------------------------------------------------------------------------

@query
def category_codes(spark, sf):
    return features.registry_features(V.static(spark, sf)).select(
        CODE, "PLATFORM", "PLATFORM_enc", "ASA_VERSION", "ASA_VERSION_enc")


@query
def features_static(spark, sf):
    made = features.registry_vector(features.registry_features(V.static(spark, sf)))
    return made.select(CODE, *[_round(c) for c in STATIC_FEATURES])


@query
def unregistered_machines(spark, sf):
    return labels.unregistered_machines(V.dynamic(spark, sf), V.static(spark, sf))


@query
def subset_machines(spark, sf):
    """Rows that the first 50 machine codes keep in each table."""
    kept = labels.machine_subset(50, V.dynamic(spark, sf), V.static(spark, sf),
                                 V.labels(spark, sf))
    names = ["dynamic", "static", "labels"]
    counted = [t.groupBy(CODE).agg(F.count(F.lit(1)).alias("n_rows"))
               .withColumn("table_name", F.lit(n)) for n, t in zip(names, kept)]
    return datasets.combine(counted)


@query
def duplicate_keys(spark, sf):
    return labels.duplicate_keys(V.dynamic(spark, sf), [CODE, "TOTAL_TKT_ISSUED_TODAY"])


@query
def src_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "dynamic-csv")
    tables.write_csv(V.dynamic(spark, sf).drop("event_id"), path)
    back = tables.read_csv(spark, path, DYNAMIC_SCHEMA)
    return back.select(*KEY, "LAST_TKT_NUMBER", _long("NETWORK_LINK"), _round("HOME_USED_MB"),
                       _round("DB_CRASH_LOG_DIR_SIZE_MB"), "DB_FREE_PAGES", "OS_UP_SINCE",
                       F.col("DB_PURGING_UPTO").isNull().alias("no_purging"))


# --- labels -----------------------------------------------------------------------------------

@query
def labels_from_degradation(spark, sf):
    return V.labels(spark, sf).select(*KEY, "fault_label", _round("rul_days"), "failure_mode")


@query
def failure_mode_counts(spark, sf):
    return labels.failure_mode_counts(V.labels(spark, sf))


@query
def failure_mode_map(spark, sf):
    return labels.failure_mode_map(V.labels(spark, sf)).select(
        F.size("modes").alias("n_modes"), F.explode("modes").alias("mode", "n_faults"))


@query
def fault_rate(spark, sf):
    return labels.fault_rate(V.labels(spark, sf)).select(_round("fault_rate"))


# --- windows ----------------------------------------------------------------------------------

@query
def latest_reading(spark, sf):
    return sequences.latest_reading(V.dynamic(spark, sf),
                                    ["event_id", "HOME_USED_MB", "NETWORK_LINK"])


@query
def latest_window(spark, sf):
    """60 readings, so that machines with fewer drop out."""
    rows = V.dynamic(spark, sf).select(*KEY, "event_id", "HOME_USED_MB")
    return sequences.latest_rows(rows, 60).select(*KEY, "step", "event_id", "HOME_USED_MB")


@query
def sequences_index(spark, sf):
    return sequences.sequence_index(V.dynamic(spark, sf), LENGTH, STRIDE)


def _labelled(spark, sf):
    return sequences.labelled_index(V.dynamic(spark, sf), V.static(spark, sf),
                                    V.labels(spark, sf), LENGTH, STRIDE)


@query
def sequences_labelled(spark, sf):
    return _labelled(spark, sf).withColumn("rul_days", _round("rul_days"))


@query
def sequences_array(spark, sf):
    static = features.registry_features(V.static(spark, sf))
    windows = sequences.array_sequences(V.dynamic(spark, sf), static, V.labels(spark, sf),
                                        LENGTH, STRIDE)
    steps = windows.select(CODE, "window_no", "target_time", "fault_label",
                           F.size("x").alias("n_steps"), F.posexplode("x").alias("step", "v"))
    names = [*DYNAMIC_FEATURES, *STATIC_FEATURES]
    return steps.select(
        CODE, "window_no", "target_time", "fault_label", "n_steps", "step",
        F.size("v").alias("n_features"),
        *[F.expr(f"round(cast(v[{i}] as double), 3) + 0.0D as {n}") for i, n in enumerate(names)])


def _pooled(spark, sf, newest=False):
    static = features.registry_features(V.static(spark, sf))
    return sequences.pooled_sequences(V.dynamic(spark, sf), static, V.labels(spark, sf),
                                      LENGTH, STRIDE, newest=newest)


@query
def sequences_pooled(spark, sf):
    return _pooled(spark, sf).select(
        CODE, "window_no", "target_time", "fault_label", _round("rul_days"),
        *[F.expr(f"round(cast(cast({c} as float) as double), 7) + 0.0D as {c}")
          for c in [*DYNAMIC_FEATURES, *STATIC_FEATURES]])


@query
def stratified_split(spark, sf):
    """The split reads the windows three times, so they are written once."""
    return ml.stratified_split(cut_lineage(_labelled(spark, sf))).select(
        CODE, "window_no", "fault_label", "is_test")


@query
def class_weights(spark, sf):
    return evaluate.class_weights(_labelled(spark, sf)).withColumn("weight", _round("weight", 9))


@query
def rul_summary(spark, sf):
    return evaluate.rul_summary(_labelled(spark, sf)).select(
        "n_windows", "n_faulty", _round("rul_mean"), _round("rul_std"))


@query
def rul_scale(spark, sf):
    """Scale from the training windows, applied to all faulty windows."""
    split = ml.stratified_split(cut_lineage(_labelled(spark, sf)))
    scale = evaluate.rul_scale(split.where(~F.col("is_test")))
    return evaluate.scaled_rul(split.where("fault_label = 1"), scale).select(
        CODE, "window_no", _round("rul_max"), _round("rul_scaled"))


# --- scoring and dashboard --------------------------------------------------------------------

PREDICTION = [CODE, TIME, "fault_probability", "predicted_rul_days", "is_fault_risk"]


def _registered_predictions(spark, sf):
    return V.predictions(spark, sf, LENGTH)


@query
def fleet_risk(spark, sf):
    return scoring.rank_by_risk(_registered_predictions(spark, sf)).select(*PREDICTION)


@query
def top_risk(spark, sf):
    return scoring.top_risk(_registered_predictions(spark, sf), 10).select(*PREDICTION)


@query
def at_risk_summary(spark, sf):
    return scoring.at_risk_summary(_registered_predictions(spark, sf))


@query
def machine_list(spark, sf):
    return dashboard.machine_list(V.static(spark, sf), _registered_predictions(spark, sf))


@query
def machine_search(spark, sf):
    machines = dashboard.machine_list(V.static(spark, sf), _registered_predictions(spark, sf))
    return dashboard.machine_search(machines, "tc00001").select(
        CODE, "TERMINAL_TYPE_ID", "fault_probability", "status")


@query
def fleet_overview(spark, sf):
    return dashboard.fleet_overview(
        spark, V.static(spark, sf), V.dynamic(spark, sf), V.labels(spark, sf),
        _registered_predictions(spark, sf))


# --- evaluation -------------------------------------------------------------------------------

@query
def fault_binary(spark, sf):
    return scoring.fault_binary(V.scored(spark, sf)).select(*KEY, "y_true", "prob", "fault_binary")


@query
def softmax_scores(spark, sf):
    from fleet_health.functions.scalars import softmax_positive

    return V.scored(spark, sf).withColumn("softmax", softmax_positive("l0", "l1")).select(
        *KEY, _round("softmax"))


@query
def classification_metrics(spark, sf):
    made = evaluate.classification_metrics(V.scored(spark, sf))
    return made.select(*[_round(c) for c in made.columns])


@query
def rul_metrics(spark, sf):
    return evaluate.rul_metrics(V.scored(spark, sf)).select(_round("rul_mae"), _round("rul_rmse"))


@query
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(V.scored(spark, sf))


@query
def confusion_long(spark, sf):
    return evaluate.confusion_long(V.scored(spark, sf))


@query
def roc_curve(spark, sf):
    return evaluate.roc_curve(V.scored(spark, sf)).select("score", _round("fpr"), _round("tpr"))


@query
def roc_auc(spark, sf):
    return evaluate.roc_auc(V.scored(spark, sf)).select(_round("auc"))


@query
def rul_pairs(spark, sf):
    return evaluate.rul_pairs(V.scored(spark, sf)).select(
        *[_round(c) for c in ("rul_true", "rul_pred", "axis_min", "axis_max")])


@query
def loss_metrics(spark, sf):
    made = evaluate.loss_metrics(V.scored(spark, sf), pos_weight=3.0, rul_alpha=0.1)
    return made.select(*[_round(c) for c in made.columns])


def _metrics(spark, sf):
    scored = V.scored(spark, sf)
    return evaluate.classification_metrics(scored).crossJoin(
        F.broadcast(evaluate.rul_metrics(scored)))


@query
def metrics_report(spark, sf):
    return evaluate.metrics_report(_metrics(spark, sf)).select(
        "line", "section", "metric", _round("value"), "text")


@query
def top_features(spark, sf):
    """Telemetry features by correlation with the fault label."""
    made = features.telemetry_features(V.dynamic(spark, sf), V.static(spark, sf),
                                       labels=V.labels(spark, sf))
    scores = evaluate.feature_importance(made.where(F.col("fault_label").isNotNull()),
                                         DYNAMIC_FEATURES, "fault_label")
    return evaluate.top_features(scores.select("feature", _round("score")), 20)


# --- other datasets ---------------------------------------------------------------------------

STATIC_OUT = [CODE, "TERMINAL_TYPE_ID", "PLATFORM", "PLATFORM_VER", "ASA_VERSION",
              "DEFAULT_COLLATION", "DB_PAGE_SIZE", "ODBC_FILE_SIZE_B", "CLIENT_EXE_SIZE_B",
              "HOME_TOTAL_MB", "HOME1_TOTAL_MB", TIME]


@query
def metro_static(spark, sf):
    return datasets.metro_static(V.metro(spark, sf)).select(*STATIC_OUT)


@query
def metro_dynamic(spark, sf):
    return datasets.metro_dynamic(V.metro(spark, sf))


@query
def metro_labels(spark, sf):
    return datasets.metro_labels(V.metro(spark, sf)).withColumn("rul_days", _round("rul_days"))


@query
def ai4i_static(spark, sf):
    return datasets.ai4i_static(V.ai4i(spark, sf)).select(*STATIC_OUT)


@query
def ai4i_dynamic(spark, sf):
    return datasets.ai4i_dynamic(V.ai4i(spark, sf))


@query
def ai4i_labels(spark, sf):
    return datasets.ai4i_labels(V.ai4i(spark, sf)).withColumn("rul_days", _round("rul_days"))


@query
def static_union(spark, sf):
    return datasets.combine([V.static(spark, sf), datasets.metro_static(V.metro(spark, sf)),
                             datasets.ai4i_static(V.ai4i(spark, sf))]).select(*STATIC_OUT)


# --- training history and models --------------------------------------------------------------

@query
def epoch_losses(spark, sf):
    made = dashboard.epoch_losses(V.batches(spark, sf))
    return made.select("epoch", *[_round(c) for c in made.columns if c != "epoch"])


@query
def history_last_epoch(spark, sf):
    """Through the JSON sink and source."""
    path = scratch_path(spark, "history")
    tables.write_history(V.history(spark, sf), path)
    return dashboard.last_epoch(tables.read_history(spark, path)).select(
        "epoch", "train_loss", "val_fault_accuracy", "val_fault_f1", "val_rul_mae")


@query
def best_epoch(spark, sf):
    return dashboard.best_epoch(V.history(spark, sf))


@query
def history_long(spark, sf):
    return dashboard.history_long(V.history(spark, sf))


@query
def model_catalog(spark, sf):
    """Configurations go through the JSON sink and source."""
    base = scratch_path(spark, "models")
    tables.write_configs(V.model_configs(spark, sf), base)
    return dashboard.model_catalog(
        tables.read_configs(spark, f"{base}/*/*.json"), V.model_files(spark, sf, 2),
        V.model_files(spark, sf, 3)).select(
        "name", "num_machines", "seq_len", "rul_max", "has_history", "is_default")


# --- raw files ----------------------------------------------------------------------------------

def _spoiled(column: str, where):
    """The column as text, with something else in some rows."""
    return F.when(where, F.lit("n/a")).otherwise(F.col(f"`{column}`").cast("string")).alias(column)


@query
def metro_csv(spark, sf):
    """A file whose first column has no name, with lines that do not fit."""
    raw, path = V.metro(spark, sf), scratch_path(spark, "metro")
    tables.write_csv(raw.select(F.col("index").alias(""), "timestamp", _spoiled("TP2", F.col("index") % 997 == 0),
                                *[c for c in raw.columns if c not in ("index", "timestamp", "TP2")]), path)
    _, dynamic, _ = datasets.load_dataset(spark, "metropt3", path)
    bad = datasets.bad_lines(spark, "metropt3", path).agg(F.count(F.lit(1)).alias("bad_lines"))
    return dynamic.select(*KEY, "LAST_TKT_NUMBER", "TOTAL_TKT_ISSUED_YESTERDAY", "NETWORK_LINK", "HOME_USED_MB",
                          "DB_FREE_PAGES").crossJoin(F.broadcast(bad))


@query
def ai4i_csv(spark, sf):
    """A file with spaces and brackets in its header, with lines that do not fit."""
    raw, path = V.ai4i(spark, sf), scratch_path(spark, "ai4i")
    tables.write_csv(raw.select(*[_spoiled(c, F.col("UDI") % 211 == 0) if c == "Torque [Nm]" else F.col(f"`{c}`")
                                  for c in raw.columns]), path)
    _, dynamic, _ = datasets.load_dataset(spark, "ai4i2020", path)
    bad = datasets.bad_lines(spark, "ai4i2020", path).agg(F.count(F.lit(1)).alias("bad_lines"))
    return dynamic.select(*KEY, "LAST_TKT_NUMBER", "NETWORK_LINK", "HOME_USED_MB").crossJoin(F.broadcast(bad))


# --- models as tables, resampling, models of one's own ------------------------------------------

@query
def balanced_draws(spark, sf):
    drawn = ml.balanced_draws(_labelled(spark, sf), [CODE, "window_no"])
    return drawn.select(CODE, "window_no", "fault_label", "copies")


#: Features of the table-driven models: none is null.
TABLE_FEATURES = ["HOME_USED_MB", "home_used_roll_mean_12", "NETWORK_LINK", "netlink_stable_hours"]


@query
def linear_model_scores(spark, sf):
    """Windows scored from a table of weights that the windows give."""
    windows = cut_lineage(_pooled(spark, sf))
    weights = models.means_as_linear(windows, TABLE_FEATURES, "fault_label")
    return windows.select(CODE, "window_no", F.round(models.linear_probability(weights), 6).alias("probability"))


@query
def tree_model_scores(spark, sf):
    """Remaining life of faulty windows from a table of tree nodes that the windows give."""
    windows = cut_lineage(_pooled(spark, sf)).where("fault_label = 1")
    nodes = models.mean_tree(windows, ["netlink_stable_hours", "HOME_USED_MB"], "rul_days")
    return windows.select(CODE, "window_no", F.round(models.tree_value(nodes), 6).alias("rul"))


def _array_model():
    """A fixed model on arrays: mean use and newest link stability."""
    import numpy as np

    used, stable = DYNAMIC_FEATURES.index("HOME_USED_MB"), DYNAMIC_FEATURES.index("netlink_stable_hours")

    def predict(x):
        x = x.astype("float64")
        p = 1 / (1 + np.exp(-(0.05 * x[:, :, used].mean(axis=1) - 0.03 * x[:, -1, stable] - 2)))
        return p, 30 * (1 - p)

    return predict


@query
def array_model_scores(spark, sf):
    """The newest window of each registered machine, scored as an array by a model of one's own."""
    static = features.registry_features(V.static(spark, sf))
    newest = sequences.latest_sequences(V.dynamic(spark, sf), static, LENGTH)
    scored = scoring.score_windows(newest, _array_model, LENGTH, len(DYNAMIC_FEATURES) + len(STATIC_FEATURES))
    return scored.select(*KEY, F.round("probability", 5).alias("probability"), F.round("rul", 4).alias("rul"))


@query
def ml_tables_agree(spark, sf):
    """Every labelled window: is it scored alike by the fitted stages, the stages after saving and
    loading with their configuration, the table of weights, and the table of tree nodes?"""
    model, split = _train(spark, sf)
    path = scratch_path(spark, "model")
    model.save(path)
    tables.write_config(spark.range(1).select(F.lit(model.rul_max).alias("rul_max")), f"{path}/config.json")
    loaded = ml.FleetModel.load(path, tables.read_configs(spark, f"{path}/config.json").first()["rul_max"])
    both = loaded.score(model.score(split).withColumnsRenamed({"probability": "_p", "rul": "_r"}))
    near = lambda a, b: F.abs(a - b) < 1e-9
    return both.select(
        CODE, "window_no", "fault_label",
        (near(F.col("_p"), F.col("probability")) & near(F.col("_r"), F.col("rul"))).alias("same_loaded"),
        near(models.linear_probability(model.fault_table()), F.col("_p")).alias("same_linear"),
        near(models.tree_value(model.rul_table()) * model.rul_max, F.col("_r")).alias("same_tree"))


# --- fitted models (rows only) ----------------------------------------------------------------

def _fit(windows):
    split = cut_lineage(ml.stratified_split(windows))
    return ml.train(split.where(~F.col("is_test"))), split


def _train(spark, sf):
    """Windows and their split are written once, since splitting and fitting read them many times."""
    return _fit(cut_lineage(_pooled(spark, sf)))


@query
def ml_fault_scores(spark, sf):
    model, split = _train(spark, sf)
    return model.score(split).select(CODE, "window_no", "fault_label",
                                     F.round("probability", 4).alias("probability"))


@query
def ml_rul_scores(spark, sf):
    model, split = _train(spark, sf)
    return model.score(split.where("fault_label = 1")).select(
        CODE, "window_no", "rul_days", F.round("rul", 2).alias("rul"))


@query
def ml_eval(spark, sf):
    model, split = _train(spark, sf)
    return ml.evaluate(model, split.where("is_test"))


@query
def ml_fleet_risk(spark, sf):
    """Train on all windows, score the newest window of each registered machine, rank. Both kinds of
    windows come from one pass over the readings, written once."""
    windows = cut_lineage(_pooled(spark, sf, newest=True))
    model, _ = _fit(windows.where(~F.col("newest")).drop("newest"))
    newest = windows.where("newest").select(CODE, F.col("target_time").alias(TIME), *ml.INPUTS)
    return scoring.rank_by_risk(scoring.as_predictions(model.score(newest)))
