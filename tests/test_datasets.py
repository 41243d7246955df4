"""Dataset adapters, on small raw files in the public formats."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleet_health.schema import CODE, TIME
from fleet_health.sources import datasets

METRO_CSV = """,timestamp,TP2,TP3,Oil_temperature,Motor_current,Reservoirs,COMP,LPS
0,2024-12-29 10:00:00,-0.012,9.358,53.6,0.04,9.344,1.0,0.0
10,2024-12-30 10:00:00,-0.014,9.348,53.675,-3.75,9.332,0.0,1.0
1000020,2024-12-31 10:00:10,8.5,9.338,50.0,0.0425,9.322,0.5,0.0
"""

AI4I_CSV = """UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF
1,M1,M,298.1,308.6,1551,42.8,0,0,0,0,0,0
2,L1,L,298.2,308.7,1408,66.3,3,1,0,1,1,0
3,H1,H,298.1,308.5,1498,49.4,5,1,0,0,0,0
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "metro.csv").write_text(METRO_CSV)
    (folder / "ai4i.csv").write_text(AI4I_CSV)
    return folder


def test_metro(spark, files):
    static, dynamic, labels = datasets.load_dataset(spark, "metropt3", str(files / "metro.csv"))
    assert {r[CODE]: r[TIME] for r in static.collect()} == {
        "2024_W52": dt.datetime(2024, 12, 29, 10), "2025_W01": dt.datetime(2024, 12, 30, 10)}
    a, b, c = dynamic.orderBy(TIME).collect()
    assert (a["LAST_TKT_NUMBER"], b["LAST_TKT_NUMBER"], c["LAST_TKT_NUMBER"]) == ("0", "10", "20")
    assert (a["TOTAL_TKT_ISSUED_YESTERDAY"], c["TOTAL_TKT_ISSUED_YESTERDAY"]) == (1, 350)
    assert a["TOTAL_TKT_ISSUED_TODAY"] == 935 % 300
    assert [r["NETWORK_LINK"] for r in (a, b, c)] == [1, 0, 0]
    assert (b["HOME_USED_MB"], b["HOME1_USED_MB"]) == (536.75, 187.5)
    assert (a["DB_FILE_SIZE_IN_PAGES"], a["DB_MRR_LOG_DIR_SIZE_MB"]) == (120, 0.0)
    assert b["DB_CRASH_LOG_DIR_SIZE_MB"] == 2.0
    assert a["OS_UP_SINCE"] == dt.datetime(2024, 11, 29, 10)
    made = {r[TIME].day: (r["fault_label"], r["rul_days"], r["failure_mode"]) for r in labels.collect()}
    assert made == {29: (0, -1.0, "none"), 30: (1, 0.0, "overheat"), 31: (0, -1.0, "none")}


def test_metro_constant_temperature(spark, files):
    raw = spark.createDataFrame([(dt.datetime(2024, 1, 1, i), 50.0) for i in range(3)],
                                "timestamp timestamp_ntz, Oil_temperature double")
    assert {r["fault_label"] for r in datasets.metro_labels(raw).collect()} == {0}


def test_ai4i(spark, files):
    static, dynamic, labels = datasets.load_dataset(spark, "ai4i2020", str(files / "ai4i.csv"))
    assert {r[CODE]: r["TERMINAL_TYPE_ID"] for r in static.collect()} == {
        "TC00001": 3, "TC00002": 2, "TC00003": 1}
    assert dynamic.count() == 72
    rows = {r[TIME].hour: r for r in dynamic.where(F.col(CODE) == "TC00002").collect()}
    assert len(rows) == 24 and rows[6]["HOME_USED_MB"] == 298.2
    assert rows[5]["HOME_USED_MB"] == pytest.approx(298.2 + 15) and rows[2]["HOME_USED_MB"] == 298.2
    assert rows[3]["HOME1_USED_MB"] == pytest.approx(308.7 + 3)
    assert rows[6]["NETWORK_LINK"] == 0 and rows[6]["TOTAL_TKT_ISSUED_TODAY"] == 663 % 300
    assert rows[6]["DB_FILE_SIZE_IN_PAGES"] == 1408
    made = labels.where(F.col(CODE) == "TC00002").orderBy(TIME).collect()
    np.testing.assert_allclose([r["rul_days"] for r in made], np.linspace(15, 0.5, 24))
    assert {r["failure_mode"] for r in made} == {"HDF"}
    rest = labels.where(F.col(CODE) != "TC00002").groupBy(CODE).agg(
        F.max("rul_days"), F.max("failure_mode")).orderBy(CODE).collect()
    assert [r[:] for r in rest] == [("TC00001", -1.0, "none"), ("TC00003", 15.0, "none")]


def test_unknown_dataset(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        datasets.load_dataset(spark, "scania", "x.csv")


def test_combine_fills_missing_columns(spark):
    a = spark.createDataFrame([("A", 1)], "TERMINAL_CODE string, x int")
    b = spark.createDataFrame([("B",)], "TERMINAL_CODE string")
    assert sorted(r[:] for r in datasets.combine([a, b]).collect()) == [("A", 1), ("B", None)]
