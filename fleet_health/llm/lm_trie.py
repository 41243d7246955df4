"""Scoring texts by an interpolated bigram model in a sharded Elias-Fano trie.

Level one has a shard per range of word hashes: the hashes, the sums of the counts up to each word
(both Elias-Fano), and for each word two quantised numbers, its probability and its back-off weight
as a context. A word's id is its place in all shards. Level two has a shard per range of bigram
hashes, so that a very frequent context is spread over all of them: its contexts' ids, the starts of
their children (monotone pointers), the children (context rank times number of words plus word id, so
that they are monotone; a search looks only between its context's pointers) and for each bigram its
quantised smoothed probability. All are flat files that tasks map into memory.

    p(w | v) = (c(v w) - D2) / c(v) + g(v) p(w)   if v w was seen, else g(v) p(w)
    p(w) = (c(w) - D1) / N                        if w was seen; all other words are one class, D1 V / N

g(v) is what D2 takes from the bigrams of v, so the probabilities add up to one, but for the
quantisation. D = n1 / (n1 + 2 n2) of the counts of one and two in all shards of the level. Codes are
log10 in steps of 1 / QUANTUM: a level-one number is off by half a step at most, and the log10 of a
token by one and a half steps (0.00037). A text starts in the context of the end token.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_health.llm.common import (load_array, mix, open_store, parts_for, save_array, slices,
                                     word_hashes, words)
from fleet_health.llm.elias_fano import EliasFano
from fleet_health.llm.packed import cut, joined, runs_of
from fleet_health.session import cut_lineage, scratch_path

#: Code points of one slice of documents, of a range of words and a range of bigrams, about.
SLICE_CHARS, WORD_CHARS, BIGRAM_CHARS = 6_000_000, 32e6, 12e6
#: Steps of the quantised log10 probability per unit; the last code stands for none.
QUANTUM, NONE = 4096, 2**16 - 1
#: Counts of bigrams from here on are listed apart until they are probabilities.
LARGE = 255
#: Files that one task keeps mapped, below the usual bound of a process.
MAPS = 20_000
END = np.uint64(0x2545F4914F6CDD1D)  # the end token's hash
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.round(-np.log10(p) * QUANTUM)
    return np.where(p > 0, np.minimum(code, NONE - 1), NONE).astype("<u2")


def _restored(code: np.ndarray) -> np.ndarray:
    return np.where(code == NONE, 0.0, 10.0 ** (-code.astype(np.float64) / QUANTUM))


def _upper(found: np.ndarray, ranges: int) -> np.ndarray:
    return (found >> HALF) * np.uint64(ranges) >> HALF


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class Words:
    """A slice's tokens, each text followed by the end token, and which texts train.

    `hashes` are the different tokens in ascending order, `place` each token's place among them.
    """

    def __init__(self, frame: pd.DataFrame):
        found = [np.append(word_hashes(words(t, lower=True)), END) for t in frame["text"]]
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.hashes, place = np.unique(np.concatenate([[END], *found]), return_inverse=True)
        self.place, self.starts = place[1:], np.cumsum(self.sizes) - self.sizes
        self.before = np.roll(self.place, 1)
        self.before[self.starts] = place[0]
        self.trains = np.repeat(~frame["held_out"].to_numpy(bool), self.sizes)

    def pairs(self, chosen: np.ndarray) -> np.ndarray:
        """Places of the chosen tokens and their predecessors in one number."""
        return self.before[chosen].astype(np.uint64) << HALF | self.place[chosen].astype(np.uint64)


def _send_words(ranges):
    def send(frames):
        for frame in slices(frames, limit=SLICE_CHARS):
            own = Words(frame)
            counts = np.bincount(own.place[own.trains], minlength=len(own.hashes))
            keys, counts = own.hashes[counts > 0], counts[counts > 0]
            yield pd.DataFrame([(r, keys[a:b].astype("<u8").tobytes(), counts[a:b].astype("<i8").tobytes())
                                for r, a, b in cut(keys, _upper(keys, ranges))],
                               columns=["r", "keys", "counts"])

    return send


def _store_words(folder):
    def store(frame):
        keys, counts = joined(frame["keys"], "<u8"), joined(frame["counts"], "<i8")
        order = np.argsort(keys, kind="stable")
        runs = runs_of(keys[order])
        keys, counts = keys[order][runs], np.add.reduceat(counts[order], runs)
        name = uuid.uuid4().hex
        save_array(folder, f"{name}.words", EliasFano.build(keys))
        save_array(folder, f"{name}.sums", EliasFano.build(np.append(0, np.cumsum(counts))))
        return pd.DataFrame([(int(frame["r"].iloc[0]), name, len(keys), int(counts.sum()),
                              int((counts == 1).sum()), int((counts == 2).sum()))],
                            columns=["r", "name", "n_words", "n_tokens", "ones", "twos"])

    return store


class Files:
    """Flat files of a folder, mapped when they are needed; a bounded number is kept."""

    def __init__(self, folder):
        self.folder, self.mapped = folder, {}

    def load(self, name, kind="<u8"):
        if name not in self.mapped:
            if len(self.mapped) >= MAPS:
                self.mapped.clear()
            found = load_array(self.folder, name, kind)
            self.mapped[name] = EliasFano(found) if kind == "<u8" else found
        return self.mapped[name]


class Level1(Files):
    """The word level. `codes` names each shard's quantised numbers, once they are stored."""

    def __init__(self, folder, shards, ranges):
        super().__init__(folder)
        self.ranges, self.codes = ranges, {}
        self.names = {s["r"]: s["name"] for s in shards}
        self.rs = sorted(self.names)
        sizes = {s["r"]: s["n_words"] for s in shards}
        self.bases = np.cumsum([0, *[sizes[r] for r in self.rs]])
        self.types = int(self.bases[-1])
        self.tokens = sum(s["n_tokens"] for s in shards)
        self.discount = _discount(sum(s["ones"] for s in shards), sum(s["twos"] for s in shards))
        #: Ids travel in as many bytes as they need.
        self.kind = "<u4" if self.types <= 2**32 else "<u8"

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids (-1: none) of different hashes in ascending order; ids ascend with the hashes."""
        out = np.full(len(hashes), -1, np.int64)
        for r, a, b in cut(hashes, _upper(hashes, self.ranges)):
            if r in self.names:
                at = self.load(f"{self.names[r]}.words").find(hashes[a:b])
                out[a:b] = np.where(at >= 0, self.bases[np.searchsorted(self.rs, r)] + at, -1)
        return out

    def _by_shard(self, ids):
        for i, a, b in cut(ids, np.searchsorted(self.bases, ids, "right") - 1):
            yield self.rs[i], slice(a, b), ids[a:b] - self.bases[i]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending ids."""
        out = np.zeros(len(ids), np.int64)
        for r, own, at in self._by_shard(ids):
            sums = self.load(f"{self.names[r]}.sums")
            out[own] = sums.access(at + 1) - sums.access(at)
        return out

    def restored(self, ids: np.ndarray, part: str) -> np.ndarray:
        """`p` (probabilities) or `weights` of ascending ids."""
        out = np.zeros(len(ids))
        for r, own, at in self._by_shard(ids):
            out[own] = _restored(self.load(f"{self.codes[r]}.{part}", "<u2")[at])
        return out


def _send_bigrams(level1, ranges):
    def send(frames):
        kind = level1.value.kind
        for frame in slices(frames, limit=SLICE_CHARS):
            own = Words(frame)
            ids = level1.value.ids(own.hashes)
            pairs, counts = np.unique(own.pairs(own.trains), return_counts=True)
            left, right = ids[pairs >> HALF], ids[pairs & LOW]
            upper = _upper(_pair_hash(left, right), ranges)
            order = np.argsort(upper, kind="stable")
            left, right, upper = left[order].astype(kind), right[order].astype(kind), upper[order]
            counts = counts[order].astype("<u4")
            yield pd.DataFrame([(r, left[a:b].tobytes(), right[a:b].tobytes(), counts[a:b].tobytes())
                                for r, a, b in cut(upper, upper)], columns=["r", "left", "right", "counts"])

    return send


def _store_bigrams(level1, folder):
    """Contexts, pointers, children and counts of a range; what its contexts have goes to their shards."""
    def store(frame):
        kind = level1.value.kind
        left, right = joined(frame["left"], kind), joined(frame["right"], kind)
        if kind == "<u4":
            order = np.argsort(left.astype(np.uint64) << HALF | right, kind="stable")
        else:
            order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        runs = np.flatnonzero(new)
        counts = np.add.reduceat(joined(frame["counts"], "<u4")[order].astype(np.int64), runs)
        left, right = left[runs], right[runs].astype(np.uint64)
        starts = runs_of(left)
        contexts, lengths = left[starts], np.diff(np.append(starts, len(left)))
        rank = np.repeat(np.arange(len(starts), dtype=np.uint64), lengths)
        large = np.flatnonzero(counts >= LARGE)
        r, name = int(frame["r"].iloc[0]), uuid.uuid4().hex
        save_array(folder, f"{name}.contexts", EliasFano.build(contexts))
        save_array(folder, f"{name}.starts", EliasFano.build(np.append(starts, len(left))))
        save_array(folder, f"{name}.children", EliasFano.build(rank * np.uint64(level1.value.types) + right))
        save_array(folder, f"{name}.counts", np.minimum(counts, LARGE).astype("<u1"))
        save_array(folder, f"{name}.large", counts[large].astype("<i8"))
        kids, upper = lengths.astype("<u4"), np.searchsorted(level1.value.bases, contexts, "right") - 1
        rows = [(r, name, int((counts == 1).sum()), int((counts == 2).sum()), -1, None, None)]
        rows += [(r, name, 0, 0, level1.value.rs[i], contexts[a:b].tobytes(), kids[a:b].tobytes())
                 for i, a, b in cut(contexts, upper)]
        return pd.DataFrame(rows, columns=["r", "name", "ones", "twos", "shard", "ids", "kids"])

    return store


def _store_codes(level1, folder, discount):
    """A level-one shard's quantised probabilities and back-off weights."""
    def store(frame):
        own, r = level1.value, int(frame["shard"].iloc[0])
        ids, kids = joined(frame["ids"], own.kind).astype(np.int64), joined(frame["kids"], "<u4")
        i = own.rs.index(r)
        base, size = int(own.bases[i]), int(own.bases[i + 1] - own.bases[i])
        counts = own.counts(base + np.arange(size))
        taken = discount * np.bincount(ids - base, weights=kids, minlength=size)
        name = uuid.uuid4().hex
        save_array(folder, f"{name}.p", _quantised((counts - own.discount) / own.tokens))
        save_array(folder, f"{name}.weights", _quantised(taken / counts))
        return pd.DataFrame([(r, name)], columns=["r", "name"])

    return store


def _store_smoothed(level1, folder, discount):
    """Each range's counts become quantised smoothed probabilities, in the order of its children."""
    def store(frames):
        own = level1.value
        for frame in frames:
            for r, name in zip(frame["r"], frame["name"]):
                contexts, starts, children = (
                    EliasFano(load_array(folder, f"{name}.{part}", "<u8")) for part in ("contexts", "starts", "children"))
                counts = load_array(folder, f"{name}.counts", "<u1").astype(np.float64)
                counts[counts == LARGE] = load_array(folder, f"{name}.large", "<i8")
                lengths = np.diff(starts.access(np.arange(starts.n)).astype(np.int64))
                left = contexts.access(np.arange(contexts.n)).astype(np.int64)
                rank = np.repeat(np.arange(contexts.n, dtype=np.uint64), lengths)
                right = children.access(np.arange(children.n)) - rank * np.uint64(own.types)
                right, back = np.unique(right.astype(np.int64), return_inverse=True)
                p = ((counts - discount) / np.repeat(own.counts(left), lengths)
                     + np.repeat(own.restored(left, "weights"), lengths) * own.restored(right, "p")[back])
                made = uuid.uuid4().hex
                save_array(folder, f"{made}.smoothed", _quantised(p))
                yield pd.DataFrame([(r, name, made)], columns=["r", "name", "smoothed"])

    return store


class Trie(Files):
    """Both levels, for scoring. `shards` names each bigram range's files."""

    def __init__(self, level1, shards, ranges):
        super().__init__(level1.folder)
        self.level1, self.shards, self.ranges = level1, shards, ranges

    def bigrams(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The codes of bigrams of word ids, ascending by the left ones; NONE where one was not seen."""
        out, upper = np.full(len(left), NONE, "<u2"), _upper(_pair_hash(left, right), self.ranges)
        order = np.argsort(upper, kind="stable")
        for r, a, b in cut(order, upper[order]):
            if r not in self.shards:
                continue
            name, smoothed = self.shards[r]
            own = order[a:b]
            new = runs_of(left[own])  # every context is looked up once
            rank = self.load(f"{name}.contexts").find(left[own[new]])
            starts, safe = self.load(f"{name}.starts"), np.maximum(rank, 0)
            first, last = starts.access(safe).astype(np.int64), starts.access(safe + 1).astype(np.int64)
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(own))))
            own, of = own[rank[of] >= 0], of[rank[of] >= 0]
            at = self.load(f"{name}.children").find(
                rank[of].astype(np.uint64) * np.uint64(self.level1.types) + right[own].astype(np.uint64),
                first[of], last[of])
            out[own[at >= 0]] = self.load(f"{smoothed}.smoothed", "<u2")[at[at >= 0]]
        return out

    def score(self, frame):
        own, level1 = Words(frame), self.level1
        n, v = level1.tokens, level1.types
        ids = level1.ids(own.hashes)
        known = np.flatnonzero(ids >= 0)
        counts = np.zeros(len(ids), np.int64)
        counts[known] = level1.counts(ids[known])
        # all unseen words are one class; an unseen context leaves the word's own probability
        single = np.full(len(ids), level1.discount * v / n if n else 1.0)
        single[known] = level1.restored(ids[known], "p")
        weight = np.ones(len(ids))
        weight[known] = level1.restored(ids[known], "weights")
        pairs, back = np.unique(own.pairs(np.ones(len(own.place), bool)), return_inverse=True)
        left, right = pairs >> HALF, pairs & LOW
        logs = np.log10(weight)[left] + np.log10(single)[right]
        both = np.flatnonzero((ids[left] >= 0) & (ids[right] >= 0))
        code = self.bigrams(ids[left[both]], ids[right[both]])
        seen = code != NONE
        logs[both[seen]] = -code[seen].astype(np.float64) / QUANTUM
        base = np.log10((counts + 1) / (n + 1 * (v + 1)))
        return pd.DataFrame({
            "doc_id": frame["doc_id"], "held_out": frame["held_out"], "n_tokens": own.sizes,
            "n_known": np.add.reduceat((counts > 0).astype(np.int64)[own.place], own.starts), "train_tokens": n,
            "base_score": np.add.reduceat(base[own.place], own.starts),
            "score": np.add.reduceat(logs[back], own.starts)})


def score(df: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that are not `held_out` (null: they train) and score all rows.

    `doc_id`, `held_out`, `n_tokens` (words and the end), `n_known` (of those seen in training),
    `train_tokens`, `base_score` (add-one unigrams) and `score`, both log10 of the text's probability.
    All words and bigrams of the training rows are in the model. A null or empty text is the end alone.
    Without training rows all unseen tokens have probability one, the class of all unseen words being
    all there is. Repeated rows and ids are scored row by row. Other columns are not read.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "trie")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    word_ranges, ranges = parts_for(df, text, WORD_CHARS), parts_for(df, text, BIGRAM_CHARS)
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"),
                     F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sent = docs.mapInPandas(_send_words(word_ranges), "r bigint, keys binary, counts binary")
    stored = sent.groupBy("r").applyInPandas(
        _store_words(folder), "r bigint, name string, n_words bigint, n_tokens bigint, ones bigint, twos bigint")
    shards = [r.asDict() for r in cut_lineage(stored).collect()]  # one small row per range
    level1 = Level1(folder, shards, word_ranges)
    shared = spark.sparkContext.broadcast(level1)  # names and sizes of the ranges' files
    sent = docs.mapInPandas(
        _send_bigrams(shared, ranges), "r bigint, left binary, right binary, counts binary")
    stored = cut_lineage(sent.groupBy("r").applyInPandas(
        _store_bigrams(shared, folder),
        "r bigint, name string, ones bigint, twos bigint, shard bigint, ids binary, kids binary"))
    own = stored.where("shard = -1")
    ones, twos = own.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    discount = _discount(ones, twos)
    codes = cut_lineage(stored.where("shard >= 0").groupBy("shard").applyInPandas(
        _store_codes(shared, folder, discount), "r bigint, name string"))
    level1.codes = {r["r"]: r["name"] for r in codes.collect()}
    shared = spark.sparkContext.broadcast(level1)
    smoothed = cut_lineage(own.select("r", "name").mapInPandas(
        _store_smoothed(shared, folder, discount), "r bigint, name string, smoothed string"))
    names = {r["r"]: (r["name"], r["smoothed"]) for r in smoothed.collect()}
    trie = spark.sparkContext.broadcast(Trie(level1, names, ranges))
    return docs.mapInPandas(
        lambda frames: map(trie.value.score, slices(frames, limit=SLICE_CHARS)),
        f"doc_id {dict(df.dtypes)[key]}, held_out boolean, n_tokens bigint, n_known bigint, "
        "train_tokens bigint, base_score double, score double")
