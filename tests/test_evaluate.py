"""Metrics, order statistics and the split, against brute force."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleet_health.operators import evaluate, ml, ordering

SCORED = "y_true int, prob double, rul_true double, rul_pred double, l0 double, l1 double"


def scored(spark, rows):
    return spark.createDataFrame(
        [(y, p, t, q, 0.0, math.log(p / (1 - p)) if 0 < p < 1 else 0.0) for y, p, t, q in rows], SCORED)


def sample(seed, n=400, levels=50):
    rng = np.random.default_rng(seed)
    return [(int(y), float(p), float(t), float(q)) for y, p, t, q in
            zip(rng.integers(0, 2, n), rng.integers(1, levels, n) / levels, rng.random(n) * 30, rng.random(n) * 30)]


def rank_sum_auc(rows):
    pos = [p for y, p, *_ in rows if y]
    neg = [p for y, p, *_ in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed,levels", [(0, 50), (1, 3), (2, 10_000)])
def test_auc_is_the_rank_sum(spark, seed, levels):
    rows = sample(seed, levels=levels)
    assert evaluate.roc_auc(scored(spark, rows)).first()[0] == pytest.approx(rank_sum_auc(rows))
    curve = evaluate.roc_curve(scored(spark, rows)).collect()
    last = min((r for r in curve if r["score"] is not None), key=lambda r: r["score"])
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)
    assert len(curve) == len({p for _, p, *_ in rows}) + 1


def test_one_class_only(spark):
    made = scored(spark, [(0, 0.9, -1.0, 3.0), (0, 0.1, -1.0, 3.0)])
    assert evaluate.roc_auc(made).first()[0] is None
    assert [r[:] for r in evaluate.confusion_matrix(made).orderBy("actual").collect()] == [(0, 1, 1), (1, 0, 0)]
    assert evaluate.classification_metrics(made).first()[:] == (0.5, 0.0, 0.0, 0.0)
    assert evaluate.rul_metrics(made).first()[:] == (0.0, 0.0)
    assert evaluate.loss_metrics(made).first()["rul_loss"] == 0.0
    assert evaluate.rul_pairs(made).count() == 0


def test_metrics_match_numpy(spark):
    rows = sample(5)
    made = scored(spark, rows)
    y, p, t, q = (np.array(c) for c in zip(*rows))
    hit = p > 0.5
    got = evaluate.classification_metrics(made).first()
    tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
    assert got["fault_accuracy"] == pytest.approx((hit == (y == 1)).mean())
    assert got["fault_f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    d = (t - q)[y == 1]
    assert evaluate.rul_metrics(made, 10.0).first()[:] == pytest.approx(
        (10 * np.abs(d).mean(), 10 * np.sqrt((d * d).mean())))
    nll = -np.log(np.where(y == 1, p, 1 - p))
    w = np.where(y == 1, 2.5, 1.0)
    loss = evaluate.loss_metrics(made, 2.5, 0.1).first()
    assert loss["fault_loss"] == pytest.approx((w * nll).sum() / w.sum())
    assert loss["total_loss"] == pytest.approx(loss["fault_loss"] + 0.1 * (d * d).mean())
    cells = [r["n"] for r in evaluate.confusion_long(made).orderBy("cell").collect()]
    assert sum(cells) == len(rows) and cells[3] == tp
    pair = evaluate.rul_pairs(made).first()
    assert pair["axis_min"] == pytest.approx(min(t[y == 1].min(), q[y == 1].min()))


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.one_of(st.integers(-3, 3), st.floats(-1e6, 1e6)), min_size=1, max_size=60),
       share=st.sampled_from([0.0, 0.05, 0.5, 0.95, 1.0]))
def test_percentile_is_exact(spark, values, share):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for sketch in (4, 100_000):
        got = ordering.exact_percentile(df, "v", share, sketch=sketch).first()[0]
        assert got == pytest.approx(float(np.percentile([float(v) for v in values], share * 100)), rel=1e-12, abs=1e-9)


def test_percentile_narrows_in_rounds(spark):
    """Coarse sketches and few values in one task, with heavy ties, against the plain percentile."""
    values = [float(i % 3000) if i % 4 else 7.0 for i in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for share in (0.0, 0.2, 0.5, 0.95, 1.0):
        got = ordering.exact_percentile(df, "v", share, sketch=20, most=50).first()[0]
        assert got == pytest.approx(float(np.percentile(values, share * 100)))
    assert ordering.exact_percentile(df.where("v < 0"), "v", 0.5).first()[0] is None


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_running_totals(spark, descending, buckets):
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.random(300) ** 8, [5.0, -4.0]]))
    values = rng.integers(0, 9, len(keys))
    df = spark.createDataFrame([(float(k), int(v)) for k, v in zip(keys, values)], "k double, v long")
    got = {r["k"]: (r["cum_v"], r["total_v"]) for r in
           ordering.running_totals(df, "k", ["v"], descending, buckets).collect()}
    sums = values[::-1].cumsum()[::-1] if descending else values.cumsum()
    assert got == {float(k): (int(s), int(values.sum())) for k, s in zip(keys, sums)}


@pytest.mark.parametrize("n0,n1", [(200, 53), (5, 1), (3000, 7)])
def test_split_share_is_exact(spark, n0, n1):
    rows = [(f"TC{i % 17}", i, int(i < n1)) for i in range(n0 + n1)]
    df = spark.createDataFrame(rows, "TERMINAL_CODE string, window_no long, fault_label int")
    got = {(r[0], r[1]): r["is_test"] for r in ml.stratified_split(df).collect()}
    for label, n in [(0, n0), (1, n1)]:
        digests = sorted((hashlib.md5(f"{c}|{k}|42".encode()).hexdigest(), (c, k))
                         for c, k, f in rows if f == label)
        want = {key for _, key in digests[:(n + 4) // 5]}
        assert {k for k, t in got.items() if t and (k[1] < n1) == bool(label)} == want
    machines = ml.stratified_split(df, by="machine")
    sides = machines.groupBy("TERMINAL_CODE").agg(F.countDistinct("is_test").alias("n"))
    assert sides.where("n <> 1").count() == 0 and machines.count() == len(rows)


def test_weights_and_scale(spark):
    df = spark.createDataFrame([(0, -1.0), (0, -1.0), (1, 0.25), (0, -1.0)], "fault_label int, rul_days double")
    assert {r[0]: r["weight"] for r in evaluate.class_weights(df).collect()} == {0: 1 / 3, 1: 1.0}
    assert evaluate.with_class_weight(df).agg(F.sum("weight")).first()[0] == pytest.approx(2.0)
    assert evaluate.rul_scale(df).first()[0] == 1.0
    assert evaluate.rul_scale(df.where("fault_label = 0")).first()[0] == 1.0
    got = evaluate.rul_summary(df).first()
    assert got[:] == (4, 1, 0.25, 0.0)
    assert ml.enough_windows(df, 4) and not ml.enough_windows(df, 5)


def test_report_lines(spark):
    metrics = spark.createDataFrame([(0.9123, 0.8, 0.75, 0.774194, 3.456)],
                                    "fault_accuracy double, fault_precision double, fault_recall double, fault_f1 double, rul_mae double")
    assert [r["text"] for r in evaluate.metrics_report(metrics).orderBy("line").collect()] == [
        "  fault_accuracy: 0.9123", "  fault_precision: 0.8000", "  fault_recall: 0.7500",
        "  fault_f1: 0.7742", "  RUL MAE: 3.46 days"]


def test_top_features(spark):
    df = spark.createDataFrame([(f"f{i}", float(i % 3)) for i in range(6)], "feature string, score double")
    assert [r[0] for r in evaluate.top_features(df, 3).collect()] == ["f2", "f5", "f1"]
    rows = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (3.0, 5.0, 1)], "a double, b double, y int")
    got = {r[0]: r[1] for r in evaluate.feature_importance(rows, ["a", "b"], "y").collect()}
    assert got["a"] == pytest.approx(0.8660254) and got["b"] == 0.0
