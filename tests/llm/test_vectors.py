"""Posting lists against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleet_health.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, list int, rep string"


def search(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    return ann.search(df, F.col("id") % 20 == 0, k, key="vec_id", vector="embedding").orderBy("query_id", "rank").collect()


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(good[q].tolist(), v.tolist())), i) for i, v in good.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def rows_of_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * 2 + rng.normal(size=16) * rng.uniform(0.2, 2)).tolist()) for i in range(1500)]
    hot = rows[20][1]
    rows += [(2000 + i, hot) for i in range(300)]
    rows += [(3000, None), (3020, []), (3040, [0.0] * 16), (3060, [1.0] * 15 + [None]), (3080, [float("nan")] * 16),
             (3100, [float("inf")] * 16), (3120, [1.0] * 7), (None, hot), rows[40], rows[40]]
    random.Random(1).shuffle(rows)
    return rows


def test_recall_ranks_scores_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 40)
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "PROBES", 24)
    rows = rows_of_vectors()
    want = brute(rows, 20)
    got = {}
    for r in search(spark, rows):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert sorted(got) == sorted(want)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
        for i, s in found:
            if i in dict(want[q]):
                assert s == pytest.approx(dict(want[q])[i], abs=1e-12)
    assert hits >= 0.9 * 20 * len(want)
    assert [i for i, _ in got[20]] == [2000 + i for i in range(20)] or got[20][0][0] in dict(want[20])


def test_few_and_no_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, None), (20, [0.0, 0.0])]) == []
    assert search(spark, [(0, [1.0, 0.0])]) == []
    got = search(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [1.0, 0.0])])
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
