"""Links by n-grams and repeated passages, against comparing everything with everything."""

import random

import pytest

from fleet_health.llm import jaccard, substrings
from fleet_health.llm.components import components

SCHEMA = "doc_id bigint, text string, n int, node int, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in rows], SCHEMA)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.choice([3, 4, 5, 8, 20, 60, 150]))] for _ in range(60)]
    line, passage = [word() for _ in range(10)], [word() for _ in range(70)]
    out = [None, "", " \n\t", "one", "one", "One", "a b c d", "a b c d e", "\x85 \xa0x", " ".join(passage * 90)]
    for words in base:
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            near = list(words)
            for _ in range(rng.randint(0, max(1, len(near) // 25))):
                near[rng.randrange(len(near))] = word()
            out.append(("\n" if rng.random() < 0.5 else " ").join(near))
        if rng.random() < 0.5:
            out.append(" ".join(line + words))
        if rng.random() < 0.3:
            out.append(" ".join(words + passage + [word()]))
        if rng.random() < 0.3:
            out.append(" ".join(passage[: rng.randint(45, 70)] + words))
    hub = [word() for _ in range(120)]
    for _ in range(40):  # near copies of one text, mostly not of each other
        near = list(hub)
        for _ in range(3):
            near[rng.randrange(len(near))] = word()
        out.append(" ".join(near))
    out.append(" ".join(hub))
    order = list(range(len(out)))
    rng.shuffle(order)
    rows = [(i * 3 + 1, t) for i, t in zip(order, out)]
    return [*rows, rows[20], rows[21]]  # repeated rows


def grams(text, n=5):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_links_equal_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_CHARS", 3000)
    monkeypatch.setattr(jaccard, "RANGE_CHARS", 5000)
    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    want = sorted((i, len(s), root(i)) for i, s in sets)
    assert sorted(map(tuple, jaccard.link(frame(spark, rows)).collect())) == want


def test_signatures_are_shared_by_all_similar_sets():
    """The first ones needed, in the order of the signatures themselves."""
    import numpy as np

    rng = np.random.default_rng(2)
    tested = 0
    for size in (3, 4, 7, 15, 40, 200, 1000) * 60:
        a = [f"w{i}" for i in rng.integers(0, 10**9, size)]
        b = a[rng.integers(0, size // 8 + 1) :] + [f"w{i}" for i in rng.integers(0, 10**9, rng.integers(0, size // 8 + 1))]
        x, y = set(a), set(b)
        if x == y or 100 * len(x & y) < 75 * len(x | y):
            continue
        sets = jaccard.Sets([" ".join(a), " ".join(b)], 1)
        found = [set(), set()]
        for doc, made, needed in sets.signatures(75, 100, np.ones(2, bool)):
            for i in (0, 1):
                found[i].update(np.sort(made[doc == i])[: needed[i]].tolist())
        assert found[0] & found[1], size
        tested += 1
    assert tested > 150


def test_null_ids_and_empty_table(spark):
    got = jaccard.link(frame(spark, [(None, "a b c d e f g"), (5, "a b c d e f g"), (None, "z")])).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == [
        ("5", 3, "5"), ("None", 1, "None"), ("None", 3, "5")]
    assert jaccard.link(frame(spark, []).where("false")).count() == 0
    assert substrings.remove_repeats(frame(spark, []).where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    parent = {}
    for a, b in edges:
        parent.setdefault(a, {a}), parent.setdefault(b, {b})
        if parent[a] is not parent[b]:
            parent[a] |= parent[b]
            for x in list(parent[a]):
                parent[x] = parent[a]
    want = {x: min(s) for x, s in parent.items() if len(s) > 1}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["label"] for r in got.collect()} == want


@pytest.mark.parametrize("width", [50, 7, 2])
def test_removed_words_equal_brute_force(spark, rows, width, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_CHARS", 3000)
    monkeypatch.setattr(substrings, "RANGE_CHARS", 5000)
    split = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(split):
        for j in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][j : j + width]), i)
    want = []
    for i, t in rows:
        w = split[i]
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert sorted(map(tuple, substrings.remove_repeats(frame(spark, rows), width).collect())) == sorted(want)


def test_large_families_are_compared_in_blocks(spark, rows, monkeypatch):
    want = sorted(map(tuple, jaccard.link(frame(spark, rows)).collect()))
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, jaccard.link(frame(spark, rows)).collect())) == want


@pytest.mark.parametrize("kind", ["path", "star", "random", "zigzag", "none"])
def test_components_by_contraction(spark, kind):
    """Long paths in any order, stars, loops, repeated edges and nulls; against union by sets."""
    rng = random.Random(3)
    names = rng.sample(range(-500, 500), 300)
    edges = {"path": list(zip(range(300), range(1, 300))), "star": [(7, x) for x in range(200)],
             "random": [(rng.choice(names), rng.choice(names)) for _ in range(260)],
             "zigzag": list(zip(names, names[1:])), "none": []}[kind]
    label = {x: x for e in edges for x in e}
    while True:
        before = dict(label)
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
        if before == label:
            break
    linked = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
    rows = [*edges, *edges[:5], (None, 4), (4, None)]
    got = components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, label[x]) for x in linked)


@pytest.mark.parametrize("most", [0, 40, 10_000])
def test_components_finished_in_one_task_or_not(spark, monkeypatch, most):
    """The same labels whether all tasks contract to the end, to few edges, or not at all; few jobs for few edges."""
    from fleet_health.llm import components as module

    monkeypatch.setattr(module, "IN_ONE_TASK", most)
    tasks, made = [], module._roots
    monkeypatch.setattr(module, "_roots", lambda ends: tasks.append(1) or made(ends))
    rng = random.Random(8)
    big = 2**62
    edges = [(big + x, big + y) for x, y in [*((i, i + 1) for i in range(60)), (-5, -90), (7, 7),
                                             *((rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45))]]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for x, y in edges:
            if x != y:
                label[x] = label[y] = min(label[x], label[y])
    got = components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted(label.items())
    assert bool(tasks) == (most < 10_000)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
