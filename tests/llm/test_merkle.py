"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleet_health.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, add=0):
    values = [*row[:3], row[3] + add if row[3] is not None else None, row[4]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i, leaf):
    beside = []
    for level in levels[:-1]:
        pair = level[i ^ 1 : (i ^ 1) + 1]
        beside += pair
        leaf = h(*([*pair, leaf] if i & 1 else [leaf, *pair]))
        i >>= 1
    return beside, leaf


def plain(rows, tampered):
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(row[2], []).append((row[0] is None, row[0] or 0, leaf_of(row), k))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        groups[x].sort()
        trees[x] = tree([g[2] for g in groups[x]])
    top = tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for j, x in enumerate(langs):
        for i, (_, _, leaf, k) in enumerate(groups[x]):
            shown = leaf_of(rows[k], 1) if rows[k][0] is not None and tampered(rows[k][0]) else leaf
            low, folded = climb(trees[x], i, shown)
            high, folded = climb(top, j, folded)
            out.append((rows[k][0], leaf, trees[x][-1][0], root, h(*low, *high), folded, folded == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows],
                               "doc_id bigint, source string, lang string, n_chars bigint, text string, rank int, _key string").repartition(4)
    fields = [F.col(c) for c in FIELDS]
    leaf, changed = merkle.leaf_digest(fields), merkle.leaf_digest([*fields[:3], fields[3] + 1, fields[4]])
    shown = F.when(F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), changed).otherwise(leaf)
    got = merkle.verify(df, leaf, shown)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, lambda i: i % 3 == 0)


def some_rows():
    rng = random.Random(4)
    langs = ["en"] * 9 + ["de", "", "é", "zz", None, "-"]
    rows = [(rng.randrange(10**6), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", f"té {i}"])) for i in range(150)]
    rows += [rows[0], rows[0], (None, None, None, None, None), (None, "x", "en", 3, "y"), (2**61 + 1, "", "only one", 0, "")]
    return [*rows, (rows[1][0], "other", rows[1][2], 5, "same id")]


@pytest.mark.parametrize("digit", [10, 2, 1])
def test_proofs(spark, digit, monkeypatch):
    """One record for each tree, or several levels of records with a ragged end."""
    monkeypatch.setattr(merkle, "DIGIT", digit)
    monkeypatch.setattr(merkle, "ROWS_EACH", 40)
    check(spark, some_rows() if digit > 1 else some_rows()[:20] + some_rows()[-3:])


def test_one_leaf_and_none(spark):
    check(spark, [(6, "s", "en", 1, "text")])
    check(spark, [(6, "s", None, None, None)])
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    leaf = merkle.leaf_digest([F.col(c) for c in FIELDS])
    assert merkle.verify(df, leaf, leaf).collect() == []


def test_identical_rows_share_records(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGIT", 2)
    check(spark, [(6, "s", "en", 1, "text")] * 21 + [(7, "s", "de", 1, "text")] * 4)
