"""Edge rules of the column expressions and row-wise features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleet_health.functions import scalars as S
from fleet_health.operators import features
from fleet_health.schema import CODE
from tests import fleet


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_lenient_int(spark):
    texts = ["abc", "1.9", None, "-3.7", "12", "", " 5 ", "1e3", "4d", "n/a", "1e300", "nan"]
    assert column(spark, texts, S.lenient_int) == [0, 1, 0, -3, 12, 0, 5, 1000, 0, 0, 0, 0]


def test_weekday_starts_on_monday(spark):
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 2, 18)]
    sines = column(spark, days, lambda c: S.weekday_cycle(c)[0], "timestamp_ntz")
    assert sines[0] == 0 and sines[1] < -0.7 and sines[2] == pytest.approx(0.781831, abs=1e-6)
    hours = column(spark, days, lambda c: S.hour_cycle(c)[0], "timestamp_ntz")
    assert hours[2] == pytest.approx(-1)


def test_ratios_guard_zero_and_null(spark):
    df = spark.createDataFrame([(3, 0), (3, None), (3, 6)], "a int, b int")
    assert [r[0] for r in df.select(S.guarded_ratio("a", "b", 100.0)).collect()] == [0, 0, 50]
    assert [r[0] for r in df.select(S.percent_of("a", "b")).collect()] == [None, None, 50]


def test_clamp_keeps_null(spark):
    assert column(spark, [-1.0, None, 2.0], S.at_least_zero, "double") == [0, None, 2]


def test_display_texts(spark):
    # 12.35 lies below its decimal form, 12.25 is an exact tie.
    values = [0.1235, 0.1225, None, 0.5, 1.0]
    assert column(spark, values, S.percent_text, "double") == [
        "12.3%", "12.3%", "—", "50.0%", "100.0%"]
    assert column(spark, [1234.56, None, 0.0], S.days_text, "double") == [
        "1234.6 days", "—", "0.0 days"]
    assert column(spark, [True, False, None], S.risk_status, "boolean") == [
        "At Risk", "Safe", "No Data"]
    assert column(spark, ["x", "", None], S.or_dash) == ["x", "—", "—"]


def test_first_set_flag(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (None, 0, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(S.first_set_flag(["a", "b", "c"])).collect()] == ["b", "none", "c"]


def test_column_or_default(spark):
    df = spark.createDataFrame([(None,)], "a int")
    assert df.select(S.column_or(df, "a", 7), S.column_or(df, "b", 7)).first()[:] == (None, 7)


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-800.0, 800.0), (800.0, -800.0)], "a double, b double")
    assert [r[0] for r in df.select(S.softmax_positive("a", "b")).collect()] == [0.5, 1.0, 0.0]


def test_category_codes(spark):
    df = spark.createDataFrame([("1", None, "y"), ("2", "b", "y"), ("3", "a", "x")],
                               "TERMINAL_CODE string, PLATFORM string, ASA_VERSION string")
    got = {r[CODE]: (r["PLATFORM_enc"], r["ASA_VERSION_enc"])
           for r in features.registry_features(df).collect()}
    assert got == {"1": (-1, 1), "2": (1, 1), "3": (0, 0)}


def test_many_categories(spark):
    df = spark.range(50_000).select(
        F.col("id").cast("string").alias(CODE), F.concat(F.lit("p"), F.expr("id * 7919 % 50000").cast("string")).alias("PLATFORM"),
        F.when(F.col("id") % 3 > 0, F.lit("v")).alias("ASA_VERSION")).repartition(7)
    want = {v: i for i, v in enumerate(sorted(f"p{i}" for i in range(50_000)))}
    got = features.registry_features(df).collect()
    assert len(got) == 50_000 and all(r["PLATFORM_enc"] == want[r["PLATFORM"]] for r in got)
    assert all(r["ASA_VERSION_enc"] == (-1 if r["ASA_VERSION"] is None else 0) for r in got)
    assert features.registry_features(df.where("false")).count() == 0


def test_disk_usage_of_unknown_and_zero_capacity(spark):
    pdf = fleet.readings({"TC1": 2, "TC2": 2, "TC3": 2})
    static = fleet.registry(["TC1", "TC2"])
    static.loc[1, "HOME_TOTAL_MB"] = 0.0
    got = features.with_disk_usage(fleet.dynamic(spark, pdf), fleet.static(spark, static)).collect()
    by_code = {r[CODE]: r["home_used_pct"] for r in got}
    assert by_code["TC2"] is None and by_code["TC3"] == 0.0 and by_code["TC1"] > 0


def test_constant_series_has_zero_zscore(spark):
    pdf = fleet.readings({"TC1": 20, "TC2": 1})
    pdf["HOME_USED_MB"] = 7.3
    got = features.zscore_features(fleet.dynamic(spark, pdf)).collect()
    assert {r["home_used_zscore"] for r in got if r[CODE] == "TC1"} == {0.0}
    assert [r["home_used_zscore"] for r in got if r[CODE] == "TC2"] == [None]


def test_feature_names_follow_window_size(spark):
    pdf = fleet.readings({"TC1": 20})
    made = features.telemetry_features(fleet.dynamic(spark, pdf),
                                       fleet.static(spark, fleet.registry(["TC1"])), window_size=6)
    assert "home_used_roll_mean_6" in features.feature_vector(made, 6).columns
