"""Periodic runs of words, by maximal pairs from the LCP-interval tree of each text.

A run of period q from word s, of length n, is the maximal pair (s, s + q): the same n - q words stand
at both places, the words before differ or one is missing, and so do the words after. So maximal
pairs whose match is long against their distance are exactly runs, and nothing needs extension.

The suffixes of a text that share their first FIRST words with another one are sorted by prefix
doubling; longest common prefixes of neighbours come from the ranks that the doubling passed through.
The intervals of equal prefixes are then merged from the deepest up. An interval keeps its positions
in order, in all and per left word. When two parts meet at depth m, their common prefixes have just m
words, and a pair is maximal where the left words differ; each position of the smaller part looks up
the other part's positions of other left words within m // (POWER - 1). One run of large exponent also
gives pairs at multiples of its period, with the same extent; the least distance is kept.

Texts are worked on where they lie, nothing is shuffled. Defined results: a null or empty text, or
one of white space, has no words and no runs. Any key may be null or repeated. A text is held in memory
whole, with about 4 bytes a word for each doubling of its longest repeat.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_health.llm.common import slices, words

#: A run is at least POWER periods and LEAST words long.
POWER, LEAST = 4, 6
#: The least number of words that both places of a run's pair share.
FIRST = LEAST - 1
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _refine(rank: np.ndarray, active: np.ndarray, step: int, ends: np.ndarray) -> np.ndarray:
    """Order the active suffixes by the rank of the suffix `step` words on; who still shares its rank.

    A rank is the place of the first suffix of its group, so a group splits without moving others.
    """
    n = len(rank)
    after = active + step
    second = np.where(after < ends, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
    order = np.argsort(rank[active].astype(np.int64) * (n + 1) + second, kind="stable")
    at, own, second = active[order], rank[active[order]], second[order]
    new_group = np.ones(len(at), bool)
    new_group[1:] = own[1:] != own[:-1]
    new = new_group.copy()
    new[1:] |= second[1:] != second[:-1]
    index = np.arange(len(at))
    group_start = index[new_group][np.cumsum(new_group) - 1]
    starts = index[new]
    part = np.cumsum(new) - 1
    rank[at] = own + (starts[part] - group_start)
    sizes = np.diff(np.append(starts, len(at)))
    return np.sort(at[sizes[part] > 1])


class Suffixes:
    """Suffixes of the texts of a slice that share FIRST words or more, in order, with their LCPs."""

    def __init__(self, code: np.ndarray, text: np.ndarray, ends: np.ndarray):
        """`code` and `text` are the word and the text number of each place, `ends` where its text ends."""
        n = len(code)
        order = np.lexsort((code, text))
        new = np.ones(n, bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (text[order][1:] != text[order][:-1])
        starts = np.flatnonzero(new)
        part = np.cumsum(new) - 1
        rank = np.empty(n, np.int32 if n < 2**31 else np.int64)
        rank[order] = starts[part]
        active = np.sort(order[np.diff(np.append(starts, n))[part] > 1])
        width = 1
        while width < FIRST and len(active):
            step = min(width, FIRST - width)
            active = _refine(rank, active, step, ends[active])
            width += step
        self.at, self.widths, self.levels = active, [], []
        self.place = np.full(n, -1, np.int32 if n < 2**31 else np.int64)
        self.place[active] = np.arange(len(active))
        while len(active):
            shared = np.full(len(self.at) + 1, -1, rank.dtype)
            shared[self.place[active]] = rank[active]
            self.levels.append(shared)
            self.widths.append(width)
            active = _refine(rank, active, width, ends[active])
            width *= 2
        self.order = self.at[np.argsort(rank[self.at], kind="stable")]
        self.lcp = self._lcp(code, ends)

    def _lcp(self, code, ends):
        """Common words of each suffix in order and the one before; 0 below FIRST."""
        lcp = np.zeros(len(self.order), np.int64)
        if len(self.order) < 2:
            return lcp
        n = len(code)
        a, b = self.order[:-1], self.order[1:]

        def shared(level, at):
            inside = self.place[np.minimum(at, n - 1)]
            return np.where(at < n, level[inside], -1)  # the last entry, for places outside, is -1

        common = np.zeros(len(a), np.int64)
        for width, level in zip(reversed(self.widths), reversed(self.levels)):
            x, y = shared(level, a + common), shared(level, b + common)
            common += np.where((x >= 0) & (x == y), width, 0)
        for _ in range(FIRST - 1):
            x, y = a + common, b + common
            common += ((common >= FIRST) & (x < ends[a]) & (y < ends[b])
                       & (code[np.minimum(x, n - 1)] == code[np.minimum(y, n - 1)]))
        lcp[1:] = np.where(common >= FIRST, common, 0)
        return lcp

    def groups(self):
        """(start, end) in the order of suffixes that share FIRST words and lie close enough for a run."""
        if not len(self.order):
            return
        edges = np.flatnonzero(self.lcp == 0)
        group = np.cumsum(self.lcp == 0) - 1
        deepest = np.maximum.reduceat(self.lcp, edges)
        by_place = np.lexsort((self.order, group))
        gaps = np.diff(self.order[by_place])
        gaps[np.diff(group[by_place]) > 0] = np.iinfo(np.int64).max
        nearest = np.minimum.reduceat(np.append(gaps, np.iinfo(np.int64).max), edges)
        close = nearest <= deepest // (POWER - 1)
        ends = np.append(edges[1:], len(self.order))
        yield from zip(edges[close].tolist(), ends[close].tolist())


def _merge(a, b, depth: int, left, found: dict):
    """Two parts of an interval: all places in order, and per left word. Adds runs to `found`."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    small, large, classes = a[0], b[0], b[1]
    reach = depth // (POWER - 1)

    def pair(x, y):
        if x > y:
            x, y = y, x
        run = x, y + depth
        if found.get(run, y) >= y - x:
            found[run] = y - x

    for own, places in a[1].items():
        for x in places:
            lo = bisect_left(large, x - reach)
            hi = bisect_right(large, x + reach, lo)
            if hi - lo <= len(classes):
                for y in large[lo:hi]:
                    if left[y] != own:
                        pair(x, y)
            elif hi > lo:
                for word, others in classes.items():
                    if word != own:
                        lo = bisect_left(others, x - reach)
                        for y in others[lo : bisect_right(others, x + reach, lo)]:
                            pair(x, y)
    for x in small:
        insort(large, x)
    for own, places in a[1].items():
        mine = classes.setdefault(own, places)
        if mine is not places:
            for x in places:
                insort(mine, x)
    return b


def _pairs(places: list[int], lcp: list[int], left, found: dict):
    """Maximal pairs of one group of suffixes in order, by intervals from the bottom up."""
    stack = []
    part = [places[0]], {left[places[0]]: [places[0]]}
    for place, depth in zip(places[1:], lcp[1:]):
        while stack and stack[-1][0] > depth:
            deeper, other = stack.pop()
            part = _merge(other, part, deeper, left, found)
        if stack and stack[-1][0] == depth:
            part = _merge(stack.pop()[1], part, depth, left, found)
        stack.append((depth, part))
        part = [place], {left[place]: [place]}
    while stack:
        depth, other = stack.pop()
        part = _merge(other, part, depth, left, found)


def runs_of(code: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period.

    `code` numbers the words of all texts in order, `lengths` says how many each text has.
    """
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    text = np.repeat(np.arange(len(lengths)), lengths)
    out = [[] for _ in lengths]
    if not len(code):
        return out
    suffixes = Suffixes(code, text, bounds[1:][text])
    before = np.empty(len(code), np.int64)
    before[1:] = code[:-1]
    before[bounds[:-1][lengths > 0]] = -1  # a text's first word has nothing before it
    left = None
    for a, b in suffixes.groups():
        left = before.tolist() if left is None else left
        found = {}
        _pairs(suffixes.order[a:b].tolist(), suffixes.lcp[a:b].tolist(), left, found)
        for (start, end), period in found.items():
            which = text[start]
            out[which].append((int(start - bounds[which]), int(end - start), int(period)))
    return [_least(x) for x in out]


def _least(found):
    """One run per extent, with its least period: a group of suffixes may know multiples only."""
    best = {}
    for start, length, period in found:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted((s, n, q) for (s, n), q in best.items())


def _collapse(found: list[bytes], runs) -> str:
    if not runs:
        return b" ".join(found).decode("utf-8", "surrogatepass")
    change = np.zeros(len(found) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    stays = np.cumsum(change)[:-1] == 0
    return b" ".join(w for w, s in zip(found, stays.tolist()) if s).decode("utf-8", "surrogatepass")


def _runs(frames):
    for frame in slices(frames, "_text", 2_000_000):
        found = [words(t) for t in frame["_text"]]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.empty(int(lengths.sum()), object)
        flat[:] = [w for ws in found for w in ws]
        runs = runs_of(pd.factorize(flat)[0].astype(np.int64), lengths)
        out = frame.drop(columns=["_text"])
        out["n_words"] = lengths
        out["runs"] = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        out["collapsed"] = [_collapse(w, r) for w, r in zip(found, runs)]
        yield out


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_words`, `runs` by start and period, and `collapsed`, for every row.

    Collapsed is the text without the words that any run holds after its first period.
    """
    # As text, since pandas has no integers with nulls.
    cut = df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    made = cut.mapInPandas(_runs, f"_key string, n_words bigint, runs {RUNS}, collapsed string")
    return made.withColumn("_key", F.col("_key").cast(dict(df.dtypes)[key])).withColumnRenamed("_key", key)


def highest(runs: Column) -> Column:
    """The run with the greatest length by period; of equals the first. Null where there is none."""
    first = (F.lit(-1), F.lit(1), F.lit(0))

    def compare(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        less = [x > y, x < y, a["start"] < b["start"], a["start"] > b["start"], a["period"] < b["period"], a["period"] > b["period"]]
        out = F.when(less[0], first[0])
        for i, test in enumerate(less[1:], 1):
            out = out.when(test, first[i % 2])
        return out.otherwise(first[2])

    return F.get(F.array_sort(runs, compare), F.lit(0))


def listed(runs: Column) -> Column:
    """Every run's `start,length,period` and a line feed."""
    lines = F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.array_join(lines, "")


def repeat_tail(text: Column, number: Column) -> Column:
    """The text's words, of which those from word a on repeat the p words from there.

    With n words and g = number div 10: a = g % n and p = 1 + (n - a) div (3 + g % 8). Only where
    `number` is divisible by 10 and there are words; other texts, and null numbers, stay as they are.
    """
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(found), F.floor(number / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # Whole periods of the tail, cut to its length: no look-up per word.
    tail = F.slice(F.flatten(F.array_repeat(F.slice(found, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(found, F.lit(1), a), tail), " ")
    return F.when((number % 10 == 0) & (F.size(found) > 0), made).otherwise(text)
