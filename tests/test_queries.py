"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from fleet_health.plans.queries import REGISTRY
from tools.check import TABLES, compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, FOLDER)
    want = db.sql(SQL[name])
    problem = compare([tuple(r) for r in df.collect()], df.columns, want.fetchall(), want.columns)
    assert problem is None, problem


def test_only_fitted_models_have_no_sql():
    assert {n for n in REGISTRY if n not in SQL} == {
        "ml_fault_scores", "ml_rul_scores", "ml_eval", "ml_fleet_risk"}


def test_entry(spark):
    rows = entry(spark).collect()
    assert 0 < len(rows) <= 10
    assert rows == sorted(rows, key=lambda r: (-r["fault_probability"], r["TERMINAL_CODE"]))


def test_fleet_risk_makes_the_features_once(spark, monkeypatch):
    """The windows to train on and the newest ones come from one feature series."""
    from fleet_health.operators import sequences

    calls, made = [], sequences.feature_series
    monkeypatch.setattr(sequences, "feature_series", lambda *a, **k: calls.append(1) or made(*a, **k))
    assert queries()["ml_fleet_risk"](spark, FOLDER).count() >= 0
    assert len(calls) == 1
