"""History features and windows: long machines in segments must equal the brute-force answer."""

import numpy as np
import pandas as pd
import pytest

from fleet_health.operators import features, scoring, sequences
from fleet_health.operators import series as R
from fleet_health.schema import CODE, DYNAMIC_FEATURES, LABELS_SCHEMA, STATIC_FEATURES, TIME
from tests import fleet

SIZES = {"TC1": 700, "TC2": 30, "TC3": 12, "TC4": 1, "TC5": 90, "TC6": 47, "TC7": 24}
HISTORY = [c for c in DYNAMIC_FEATURES if "_roll_" in c] + [
    "home_used_diff", "db_free_diff", "netlink_stable_hours", "home_used_zscore",
    "db_free_zscore", "home_used_pct", "os_uptime_hours"]
LIMITS = [5, 40, 1_000_000]


@pytest.fixture(scope="module")
def data(spark):
    pdf = fleet.readings(SIZES)
    registry = fleet.registry(["TC1", "TC2", "TC3", "TC4", "TC5", "TC7"])
    rng = np.random.default_rng(1)
    labels = pdf[[CODE, TIME]].sample(frac=0.9, random_state=2).assign(
        fault_label=lambda d: rng.integers(0, 2, len(d)),
        rul_days=lambda d: rng.random(len(d)) * 30)
    return (pdf, registry, labels, fleet.dynamic(spark, pdf).cache(),
            fleet.static(spark, registry).cache(),
            fleet.to_spark(spark, labels, LABELS_SCHEMA).cache())


@pytest.mark.parametrize("limit", LIMITS)
def test_features_match_brute_force(data, limit):
    pdf, registry, _, rows, static, _ = data
    got = features.telemetry_features(rows, static, max_rows=limit).select(
        CODE, TIME, *HISTORY).toPandas().sort_values([CODE, TIME]).reset_index(drop=True)
    want = fleet.expected_features(pdf, registry).sort_values([CODE, TIME]).reset_index(drop=True)
    assert len(got) == len(want)
    for name in HISTORY:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float),
                                   rtol=1e-9, atol=1e-9, err_msg=name)


def test_small_limit_cuts_long_machines_evenly(data):
    rows = data[3]
    cuts = R.cut_points(rows, 11, 40)
    placed = R.place(rows, cuts).groupBy(CODE, R.SEGMENT).count().toPandas()
    sizes = placed[placed[CODE] == "TC1"]["count"]
    assert len(sizes) > 10 and sizes.max() <= 4 * 40 and sizes.min() >= 11
    assert len(placed[placed[CODE] == "TC2"]) == 1


@pytest.mark.parametrize("name,function", [
    ("rolling", lambda r, m: features.rolling_features(r, max_rows=m)),
    ("diff", lambda r, m: features.difference_features(r, max_rows=m)),
    ("link", lambda r, m: features.link_stability(r, max_rows=m)),
    ("z", lambda r, m: features.zscore_features(r, max_rows=m))])
def test_single_groups_do_not_depend_on_segments(data, name, function):
    rows = data[3]
    a, b = (function(rows, m).toPandas().sort_values([CODE, TIME]).reset_index(drop=True)
            for m in (7, 1_000_000))
    pd.testing.assert_frame_equal(a[b.columns], b, rtol=1e-9)


def windows_of(pdf, length, stride):
    for code, g in pdf.groupby(CODE):
        g = g.sort_values(TIME).reset_index(drop=True)
        for k, i in enumerate(range(0, len(g) - length + 1, stride)):
            yield code, k, g[i:i + length]


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("length,stride", [(24, 8), (12, 5), (1, 1), (5, 9), (48, 12), (90, 7)])
def test_window_index(data, limit, length, stride):
    pdf, _, _, rows, _, _ = data
    got = {(r[0], r[1]): (r[2], r[3]) for r in
           sequences.sequence_index(rows, length, stride, max_rows=limit).collect()}
    want = {(c, k): (w[TIME].iloc[0].to_pydatetime(), w[TIME].iloc[-1].to_pydatetime())
            for c, k, w in windows_of(pdf, length, stride)}
    assert got == want


def expected_windows(data, length, stride):
    pdf, registry, labels, *_ = data
    made = fleet.expected_features(pdf, registry)
    known = {(r[0], r[1]): (r[2], r[3]) for r in labels.itertuples(index=False)}
    codes = set(registry[CODE])
    return {(c, k): (w, known[c, w[TIME].iloc[-1]]) for c, k, w in windows_of(made, length, stride)
            if c in codes and (c, w[TIME].iloc[-1]) in known}


@pytest.mark.parametrize("limit", LIMITS)
def test_labelled_windows(data, limit):
    *_, rows, static, labels = data
    want = expected_windows(data, 24, 8)
    got = {(r[CODE], r["window_no"]): r for r in
           sequences.labelled_index(rows, static, labels, 24, 8, max_rows=limit).collect()}
    assert got.keys() == want.keys()
    for key, (window, (fault, rul)) in want.items():
        assert got[key]["target_time"] == window[TIME].iloc[-1].to_pydatetime()
        assert (got[key]["fault_label"], got[key]["rul_days"]) == (fault, rul)


@pytest.mark.parametrize("limit,length,stride", [(5, 24, 8), (40, 24, 8), (10**6, 24, 8),
                                                 (40, 12, 30), (40, 10, 4), (7, 5, 3), (40, 5, 1)])
def test_pooled_and_array_windows(data, limit, length, stride):
    *_, rows, static, labels = data
    static = features.registry_features(static)
    want = expected_windows(data, length, stride)
    pooled = {(r[CODE], r["window_no"]): r for r in sequences.pooled_sequences(
        rows, static, labels, length, stride, pools=("avg", "last", "max", "min", "std"),
        max_rows=limit).collect()}
    arrays = {(r[CODE], r["window_no"]): r for r in sequences.array_sequences(
        rows, static, labels, length, stride, max_rows=limit).collect()}
    assert pooled.keys() == want.keys() == arrays.keys()
    for key, (window, (fault, _)) in want.items():
        assert pooled[key]["fault_label"] == fault
        x = np.array(arrays[key]["x"], dtype=float)
        assert x.shape == (length, 41)
        for name in HISTORY:
            values = window[name].astype(float).to_numpy()
            np.testing.assert_allclose(pooled[key][name], values.mean(), rtol=1e-8, atol=1e-9)
            np.testing.assert_allclose(pooled[key][f"{name}_last"], values[-1], rtol=1e-8, atol=1e-9)
            np.testing.assert_allclose(pooled[key][f"{name}_max"], values.max(), rtol=1e-8, atol=1e-9)
            np.testing.assert_allclose(pooled[key][f"{name}_min"], values.min(), rtol=1e-8, atol=1e-9)
            np.testing.assert_allclose(pooled[key][f"{name}_std"], values.std(ddof=1), rtol=1e-6, atol=1e-7)
            np.testing.assert_allclose(x[:, DYNAMIC_FEATURES.index(name)], values, rtol=1e-5, atol=1e-5)
        assert (x[:, 33 + 4] == x[0, 33 + 4]).all()


@pytest.mark.parametrize("limit", LIMITS)
def test_newest_windows(data, limit):
    pdf, registry, _, rows, static, _ = data
    static = features.registry_features(static)
    made = fleet.expected_features(pdf, registry)
    newest = {c: g.sort_values(TIME)[-24:] for c, g in made.groupby(CODE) if len(g) >= 24}
    registered = {c: g for c, g in newest.items() if c in set(registry[CODE])}
    arrays = {r[CODE]: r for r in sequences.latest_sequences(
        rows, static, 24, max_rows=limit).collect()}
    pooled = {r[CODE]: r for r in sequences.latest_pooled(
        rows, static, 24, max_rows=limit).collect()}
    assert arrays.keys() == pooled.keys() == registered.keys()
    for code, window in registered.items():
        x = np.array(arrays[code]["x"], dtype=float)
        assert arrays[code][TIME] == window[TIME].iloc[-1].to_pydatetime()
        for name in HISTORY:
            values = window[name].astype(float).to_numpy()
            np.testing.assert_allclose(x[:, DYNAMIC_FEATURES.index(name)], values, rtol=1e-5, atol=1e-5)
            np.testing.assert_allclose(pooled[code][name], values.mean(), rtol=1e-8, atol=1e-9)
    scores = {r[CODE]: r for r in scoring.linear_scores(rows, static, 24, max_rows=limit).collect()}
    assert scores.keys() == registered.keys()
    for code, w in registered.items():
        z = 0.05 * w["HOME_USED_MB"].mean() - 0.03 * w["netlink_stable_hours"].iloc[-1] - 2
        assert scores[code]["fault_probability"] == pytest.approx(1 / (1 + np.exp(-z)), abs=6e-5)
    ranked = sequences.latest_rows(rows.select(CODE, TIME, "HOME_USED_MB"), 24).collect()
    assert {r[CODE] for r in ranked} == newest.keys() and len(ranked) == 24 * len(newest)


def test_stored_training_values(spark, data):
    """Scoring with stored dictionary, time and moments equals training-time features."""
    _, _, _, rows, static, _ = data
    from pyspark.sql import functions as F

    stats = features.machine_moments(rows)
    now = features.latest_time(rows)
    part = rows.where(F.col("HOME_USED_MB") > 50)
    got = features.telemetry_features(part, static, now=now, stats=stats)
    full = features.telemetry_features(rows, static)
    both = got.select(CODE, TIME, F.col("home_used_zscore").alias("z"),
                      F.col("os_uptime_hours").alias("h")).join(full, [CODE, TIME])
    bad = both.where((F.abs(F.col("z") - F.col("home_used_zscore")) > 1e-9)
                     | (F.abs(F.col("h") - F.col("os_uptime_hours")) > 1e-9))
    assert both.count() == part.count() and bad.count() == 0
    codes = features.category_dictionary(static, ["PLATFORM", "ASA_VERSION"])
    one = features.registry_features(static.where("PLATFORM = 'b'"), codes)
    assert {r["PLATFORM_enc"] for r in one.collect()} == {1}


def test_windows_copy_no_rows_and_shuffle_once(data):
    """Panes: nothing is exploded, and windows add no exchange to those of the features."""
    *_, rows, static, labels = data
    static = features.registry_features(static)
    args = (rows, static, labels, 24, 8)
    exchanges = set()
    for made in (sequences.pooled_sequences(*args), sequences.array_sequences(*args),
                 features.feature_series(rows, static, 12, (), 24, labels, carry=STATIC_FEATURES)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        exchanges.add((plan.count("hashpartitioning(TERMINAL_CODE#"), plan.count("Generate ")))
    assert len(exchanges) == 1


@pytest.mark.parametrize("limit", LIMITS)
def test_newest_windows_come_along(data, limit):
    """The labelled windows and the newest ones of one pass are those of two."""
    _, _, _, rows, static, labels = data
    static = features.registry_features(static)
    both = sequences.pooled_sequences(rows, static, labels, 24, 8, max_rows=limit, newest=True).toPandas()
    apart = sequences.latest_pooled(rows, static, 24, max_rows=limit).toPandas().sort_values(CODE)
    newest = both[both["newest"]].sort_values(CODE)
    assert list(newest[CODE]) == list(apart[CODE]) == ["TC1", "TC2", "TC5", "TC7"]
    assert list(newest["target_time"]) == list(apart[TIME]) and newest["window_no"].isna().all()
    names = [*DYNAMIC_FEATURES, *STATIC_FEATURES]
    np.testing.assert_allclose(newest[names].astype(float), apart[names].astype(float), rtol=1e-9)
    key = [CODE, "window_no"]
    want = sequences.pooled_sequences(rows, static, labels, 24, 8, max_rows=limit).toPandas().sort_values(key)
    kept = both[~both["newest"]].sort_values(key)
    assert list(kept[CODE]) == list(want[CODE]) and list(kept["fault_label"]) == list(want["fault_label"])
    np.testing.assert_allclose(kept[names].astype(float), want[names].astype(float), rtol=1e-9)


def test_panes_are_hashed_and_labels_need_no_range(data):
    _, _, _, rows, static, labels = data
    made = sequences.pooled_sequences(rows, features.registry_features(static), labels, 24, 8)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "RangeFrame, currentrow$(), currentrow$()" not in plan
