"""Language models against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleet_health.llm import lm_trie, quality
from fleet_health.llm.elias_fano import EliasFano

SCHEMA = "doc_id bigint, text string, lang string, held_out string, g int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "clash", 1, 0.5) for i, t, l in rows], SCHEMA)


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(80)]
    out = [(0, None, "en"), (1, "", "en"), (2, " \n", "de"), (3, "A a A", None), (4, "ab " * 9000, "en")]
    for i in range(5, 160):
        text = " ".join(rng.choice(words[: rng.choice([5, 80])]) for _ in range(rng.randint(1, 60)))
        out.append((i, text.upper() + "!!" if i % 11 == 0 else text, rng.choice(["en", "de"])))
    return [*out, out[20], (None, "ab c", "en")]


def held(row_id):
    return row_id is not None and row_id % 4 == 1


@pytest.mark.parametrize("parts", [1, 9])
def test_one_bigram_discount_for_all_shards(spark, monkeypatch, parts):
    """Scores do not depend on the number of shards."""
    monkeypatch.setattr(lm_trie, "parts_for", lambda *_, **__: parts)
    got = lm_trie.score(frame(spark, corpus()), F.col("doc_id") % 4 == 1).collect()
    monkeypatch.setattr(lm_trie, "parts_for", lambda *_, **__: 4)
    want = lm_trie.score(frame(spark, corpus()), F.col("doc_id") % 4 == 1).collect()
    table = lambda x: Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in x)
    assert table(got) == table(want)


@pytest.mark.parametrize("kind", ["<u4", "<u8"])
def test_trie_scores_equal_a_dictionary_model(spark, monkeypatch, kind):
    """A token's log10 is off by one and a half quantisation steps at most; with narrow and wide ids."""
    monkeypatch.setattr(lm_trie, "SLICE_CHARS", 2500)
    monkeypatch.setattr(lm_trie, "MAPS", 5)  # files are let go and mapped again
    monkeypatch.setattr(lm_trie, "parts_for", lambda *_, **__: 7)
    made = lm_trie.Level1.__init__
    monkeypatch.setattr(lm_trie.Level1, "__init__", lambda self, *given: (made(self, *given), vars(self).update(kind=kind))[0])
    rows = [*corpus(), (500, "once only " + "ab c " * 400, "en"), (501, "once only again", "en")]
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, _ in rows]
    uni, bi = Counter(), Counter()
    for (i, _, _), w in zip(rows, tokens):
        if not held(i):
            uni.update(w)
            bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (lm_trie._discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())) for c in (uni, bi))
    kids = Counter(a for a, _ in bi)

    def p(a, w):
        single = (uni[w] - d1 if uni[w] else d1 * v) / n
        return single if not uni[a] else d2 * kids[a] / uni[a] * single + max(bi[a, w] - d2, 0) / uni[a]

    assert max(bi.values()) >= lm_trie.LARGE and min(bi.values()) == 1
    assert all(abs(sum(p(a, w) for w in [*uni, b"never seen"]) - 1) < 1e-9 for a in (b"once", b"a", None))
    plain, want = Counter(), defaultdict(set)
    for (i, _, _), w in zip(rows, tokens):
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        plain[i, held(i), len(w), sum(x in uni for x in w), n, round(base, 6)] += 1
        want[i].add((len(w), sum(math.log10(p(a, x)) for a, x in zip([None, *w], w))))
    got = lm_trie.score(frame(spark, rows), F.col("doc_id") % 4 == 1).collect()
    assert Counter((*r[:5], round(r[5], 6)) for r in got) == plain
    step = 1.5 / lm_trie.QUANTUM
    for r in got:
        assert any(r["n_tokens"] == m and r["score"] == pytest.approx(x, abs=step * m) for m, x in want[r["doc_id"]])


def test_search_between_pointers():
    """A successor search that is bounded finds what a search in that part alone finds."""
    rng = np.random.default_rng(5)
    values = np.sort(rng.integers(0, 4000, 900).astype(np.uint64))
    tree = EliasFano(EliasFano.build(values))
    x = rng.integers(0, 4100, 3000).astype(np.uint64)
    first = rng.integers(0, 901, 3000)
    last = np.minimum(first + rng.integers(0, 300, 3000), 900)
    want = [a + np.searchsorted(values[a:b], y) for a, b, y in zip(first, last, x)]
    assert tree.successor(x, first, last).tolist() == want
    held_there = [p if p < b and values[p] == y else -1 for p, b, y in zip(want, last, x)]
    assert tree.find(x, first, last).tolist() == held_there
    assert tree.successor(x).tolist() == np.searchsorted(values, x).tolist()


def test_trie_with_shards_of_bigrams_is_close(spark):
    rows = corpus()
    got = lm_trie.score(frame(spark, rows), F.col("doc_id") % 4 == 1).where("held_out")
    a, b = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert a > b


@pytest.mark.parametrize("rows,which", [([], "false"), ([(1, "a b", "en"), (2, None, "en")], "true")])
def test_trie_without_training(spark, rows, which):
    got = lm_trie.score(frame(spark, rows).where("doc_id IS NOT NULL"), F.expr(which)).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in got] == [(0, 0, 0, 0)] * len(rows)


def kneser_ney(texts):
    """The model as nested dictionaries, one language."""
    counts = {4: Counter()}
    pad = lambda t: [0, 0, 0, *[min(ord(c), 65534) + 1 for c in t]]
    for t in texts:
        p = pad(t)
        counts[4].update(tuple(p[i : i + 4]) for i in range(len(p) - 3))
    for o in (3, 2, 1):
        counts[o] = Counter(k[1:] for k in counts[o + 1])
    return counts, pad


def probability(counts, times, gram):
    p = 1 / (len(counts[1]) + 1)
    for o in (1, 2, 3, 4):
        n1, n2, n3, n4 = (times[o].get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
        d = [min(max(x, 0.05), i) for i, x in enumerate(d, 1)]
        g = gram[4 - o :]
        follow = counts[o, g[:-1]]
        if follow:
            total = sum(follow.values())
            cut = sum(d[min(c, 3) - 1] for c in follow.values())
            c = follow.get(g[-1], 0)
            p = (c - d[min(c, 3) - 1] if c else 0) / total + cut / total * p
    return p


def test_perplexity_equals_a_dictionary_model(spark):
    rows = corpus()
    trusted_ids = [i for i, t, l in rows if i is not None and i % 11 and i > 4]
    df = frame(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in [*trusted_ids, trusted_ids[0], None]], "doc_id bigint")
    got = quality.judge(df, trusted).collect()
    assert len(got) == len(rows)
    folds = dict(df.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(quality.FOLDS))).collect())
    models = {}
    for lang in ("en", "de"):
        models[lang] = kneser_ney([t for i, t, l in rows if l == lang and i in trusted_ids and folds[i] > 0])
    # each language has its own discounts
    times = {lang: {o: Counter(counts[o].values()) for o in (1, 2, 3, 4)} for lang, (counts, _) in models.items()}
    for counts, _ in models.values():
        for o in (1, 2, 3, 4):
            for g, c in list(counts[o].items()):
                counts.setdefault((o, g[:-1]), {})[g[-1]] = c
        counts.update({k: v for k, v in counts.items()})
    by = {i: (t, l) for i, t, l in rows}
    for r in got:
        text, lang = by[r["doc_id"]]
        if not text or lang is None:
            assert r["perplexity"] is None and r["keep"] == bool(text)
            continue
        counts, pad = models[lang]
        find = defaultdict(dict, {k: v for k, v in counts.items()})
        p = pad(text)
        logs = [math.log(probability(find, times[lang], tuple(p[i : i + 4]))) for i in range(min(len(p) - 3, 400))]
        if len(text) <= 400:
            assert r["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
        assert r["keep"] == (r["perplexity"] <= r["threshold"])
    loud = [r for r in got if r["doc_id"] and r["doc_id"] % 11 == 0 and r["doc_id"] > 4]
    assert sum(r["keep"] for r in loud) < 0.2 * len(loud)
    good = [r for r in got if r["doc_id"] in trusted_ids]
    assert sum(r["keep"] for r in good) > 0.9 * len(good)


def test_quality_without_trusted_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint")
    got = quality.judge(frame(spark, corpus()), none).collect()
    assert all(r["keep"] == bool(r["perplexity"] is None and r["doc_id"] not in (0, 1)) for r in got)
    assert quality.judge(frame(spark, []).where("false"), none).count() == 0


def test_all_trusted_documents_beyond_the_training_set_the_thresholds(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_TRUSTED", 60)
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abc" if i % 3 else "uvwxyz") for _ in range(4)) for _ in range(12)),
             "en" if i % 3 else "de") for i in range(600)]
    df, trusted = frame(spark, rows), spark.range(600).withColumnRenamed("id", "doc_id")
    keys = quality.training_keys(df.selectExpr("doc_id AS key", "lang"), trusted.withColumnRenamed("doc_id", "key"))
    trains = {r[0] for r in keys.collect()}
    by = Counter(rows[i][2] for i in trains)
    assert by["en"] < 60 and by["de"] < 60 and min(by.values()) > 10
    got = quality.judge(df, trusted).collect()
    limits = {}
    for lang in ("en", "de"):
        rest = sorted(r["perplexity"] for r in got if r["lang"] == lang and r["doc_id"] not in trains)
        assert len(rest) > 100
        limits[lang] = quality.SLACK * rest[math.ceil(quality.QUANTILE * len(rest)) - 1]
        assert all(r["threshold"] == pytest.approx(limits[lang]) for r in got if r["lang"] == lang)
    assert limits["en"] != limits["de"]


@pytest.mark.parametrize("sizes,most,level", [([], 5, 0), ([1, 2], 5, 2), ([1, 9, 9], 11, 5), ([7], 3, 3), ([0, 4], 4, 4)])
def test_languages_share_the_training(sizes, most, level):
    assert quality._level(sizes, most) == level


def test_all_trusted_documents_but_one_fold_train(spark, monkeypatch):
    """There is no limit to them, and their keys may fill many shards."""
    assert quality.MAX_TRUSTED is None
    rng = random.Random(6)
    rows = [(i - 150, "".join(rng.choice("abcd ") for _ in range(30)), "en") for i in range(300)]
    df, trusted = frame(spark, [*rows, (None, "dddd", "en")]), spark.range(-150, 150).withColumnRenamed("id", "doc_id")
    plain = quality.judge(df, trusted).collect()
    monkeypatch.setattr(quality, "SHARD", 20)
    sent = []
    made = quality._members
    monkeypatch.setattr(quality, "_members", lambda keys, folder: sent.append(keys) or made(keys, folder))
    got = quality.judge(df, trusted).collect()
    folds = dict(df.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(quality.FOLDS))).collect())
    assert {r[0] for r in sent[0].collect()} == {i for i, _, _ in rows if folds[i] > 0}
    assert sorted(map(str, got)) == sorted(map(str, plain))


def test_training_keys_in_shards():
    keys = np.sort(mixed := np.random.default_rng(3).integers(0, 2**64, 500, np.uint64))
    made = quality.Members("", dict.fromkeys(range(6), ""), 7)
    made.opened = {r: keys[quality._range(keys, 7) == r] for r in range(6)}
    asked = np.concatenate([mixed, mixed + np.uint64(1), mixed[:9]])
    want = np.isin(asked, keys) & (quality._range(asked, 7) < 6)
    assert made.hold(asked.view(np.int64)).tolist() == want.tolist()
