"""Periodic runs and line dedup against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleet_health.llm import line_dedup, runs

SPACE = " \t\n\x0b\x0c\r"


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_runs_of_small_alphabets(texts):
    code = np.array([x for t in texts for x in t], np.int64)
    assert runs.runs_of(code, np.array([len(t) for t in texts])) == [plain_runs(t) for t in texts]


def test_runs_of_long_periodic_texts():
    rng = random.Random(5)
    for period, length in [(1, 30_000), (2, 30_001), (997, 20_000), (5000, 20_000)]:
        base = [rng.randrange(50) if period > 1 else 0 for _ in range(period)]
        base = base if period != 2 else [0, 1]
        w = [99, *(base[i % period] for i in range(length)), 98]
        assert (1, length, period) in runs.runs_of(np.array(w), np.array([len(w)]))[0]


def run_texts():
    rng = random.Random(11)
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "x y x y x y x y", "x y x y x y x", "Ab ab Ab ab Ab ab Ab ab",
           "é 世 é 世 é 世 é 世 é 世", "a b a b a b a b a b a b", "w " * 5000, "p q r s " * 700]
    for _ in range(60):
        w = [rng.choice("abc") for _ in range(rng.choice([8, 30, 120]))]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out


def test_find_runs_and_collapsed_texts(spark):
    texts = run_texts()
    rows = [*enumerate(texts), (3, texts[6]), (None, texts[7]), (2**62 + 1, texts[11])]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, runs int, _text string").repartition(3)
    got = runs.find_runs(df).withColumn("best", runs.highest(F.col("runs"))).withColumn("listed", runs.listed(F.col("runs")))
    got = [(r["doc_id"], r["n_words"], r["listed"], r["collapsed"], tuple(r["best"]) if r["best"] else None) for r in got.collect()]
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = plain_runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want.append((i, len(w), "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for k, x in enumerate(w) if k not in gone), best))
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=str) == sorted(want, key=str) and len(set(map(key, got))) > 50
    assert runs.find_runs(df.where("false")).count() == 0


def test_repeated_tails(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "only", *(" ".join(rng.choice(["ab", "c", "dé"]) + str(rng.randrange(9)) for _ in range(n)) for n in range(1, 90))]
    rows = [(k, 10 * rng.randrange(10**6) + (k % 5 == 4), t) for k, t in enumerate(texts)] + [(500, None, "a b c")]
    df = spark.createDataFrame(rows, "k int, n bigint, text string")
    got = {r["k"]: r["t"] for r in df.select("k", runs.repeat_tail(F.col("text"), F.col("n")).alias("t")).collect()}
    for k, h, t in rows:
        w = (t or "").split()
        if w and h is not None and h % 10 == 0:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[k].split() == [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        else:
            assert got[k] == t


def line_texts():
    rng = random.Random(9)
    common = ["A License line, in many texts", "  second common line\t", "short", "123456789", "1234567890", "ÀÉ É É É É É", "  odd space at its end  "]
    out = [None, "", "\n", "\n\n\n", "1234567890", "1234567890\r", " 1234567890 \x0b", "a 1234567890", "ÀÉ É É É É É", "àé é é é é é"]
    for _ in range(80):
        n = rng.choice([1, 3, 10, 200])
        out.append("\n".join(rng.choice([rng.choice(common), rng.choice(common).upper(), f"own line {rng.randrange(10**6)}", ""]) for _ in range(n)))
    out.append("\n".join([*(f"unlike any other {i}" for i in range(3000)), common[0], "end of it all"]))
    return out


@pytest.mark.parametrize("hot", [500_000, 64])
def test_line_dedup(spark, hot, monkeypatch):
    """With null and repeated ids; with every key spread over slots, or none."""
    monkeypatch.setattr(line_dedup, "CHARS_EACH", 2000)
    if hot < 1000:
        monkeypatch.setattr(line_dedup, "PICKED", 1)
        monkeypatch.setattr(line_dedup, "HOT_SHARE", 0.0)
    texts = line_texts()
    rows = [*((7 * i % 101, t) for i, t in enumerate(texts)), (7, texts[30]), (7, texts[30]), (14, texts[40]),
            *((None, t) for t in texts[50:60]), (None, texts[4])]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, keep string, _key int").repartition(5)
    clean = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = clean(line)
            if len(k) >= 10 and i is not None:
                first[k] = min(i, first.get(k, i))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [clean(x) in first and (i is None or i > first[clean(x)]) for x in lines]
        want.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    got = line_dedup.remove_lines(df)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "keep", "kept"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_line_dedup_of_nothing_and_of_plain_plans(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.remove_lines(empty).count() == 0
    df = spark.createDataFrame([("b", "the same long line"), ("a", "the same long line\nmore")], "doc_id string, text string")
    made = line_dedup.remove_lines(df)
    assert {r["doc_id"]: r["kept"] for r in made.collect()} == {"a": "the same long line\nmore", "b": ""}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_bitmaps_are_short(spark):
    """A word of 64 lines for each place where lines go, whatever the length of the text."""
    own = "\n".join(f"unlike any other {i}" for i in range(64_000))
    df = spark.createDataFrame([(1, "the common line"), (2, own + "\nthe common line\n" + own[:0])], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.remove_lines(df).collect()}
    assert [(w["gap"], w["keep"]) for w in got[2]["keep"]] == [(1000, ~1)] and got[1]["keep"] is None
    assert hashlib.md5(got[2]["kept"].encode()).digest() == hashlib.md5((own + "\n").encode()).digest()
