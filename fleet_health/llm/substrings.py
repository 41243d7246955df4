"""Removing passages that repeat across documents, found by fixed-block anchors.

A window is `width` consecutive words. Blocks of `width / 2` words at multiples of their length are
the anchors of each document: any window holds a whole one. Every rolling block of every document
probes them. Around the hits, windows are compared: a window whose words also start in a document of
smaller id is covered, and runs of covered windows are the maximal repeats.

Documents are dealt into groups by a hash of their id. A group sends the hashes of its different
blocks, sorted and packed into one row per hash range, so that a block that occurs everywhere costs
one entry per group, and no pair of documents is ever formed. The ranges answer each group which of
its blocks are hits; the windows around them go the same way, with the least id of the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.llm.common import parts_for, rolling, word_hashes, words
from fleet_health.llm.packed import answer, cut, joined, ranged, runs_of

#: Code points of one group of documents and of one hash range, about.
GROUP_CHARS, RANGE_CHARS = 8e6, 12e6
NO_ID = 2**63 - 1


class Group:
    """The words of a group's documents as one run of hashes."""

    def __init__(self, frame: pd.DataFrame):
        hashes = [word_hashes(words(t)) for t in frame["text"]]
        self.sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        self.hashes = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.row = np.repeat(np.arange(len(hashes)), self.sizes)
        self.ids = frame["order_id"].to_numpy(np.int64)

    def windows(self, width: int):
        """Positions of the windows inside one document, and their hashes."""
        found = rolling(self.hashes, width)
        at = np.flatnonzero(np.arange(len(found)) + width <= self.ends[self.row[: len(found)]])
        return at, found[at]


def _send_blocks(block, ranges):
    def send(frame):
        group = Group(frame)
        at, found = group.windows(block)
        keys = ranged(found, ranges)
        anchors = np.unique(keys[(at - group.starts[group.row[at]]) % block == 0])
        keys, counts = np.unique(keys, return_counts=True)
        flags = (counts > 1).astype(np.uint8) * 2
        flags[np.searchsorted(keys, anchors)] |= 1
        g, low = int(frame["g"].iloc[0]), keys.astype("<u4")
        return pd.DataFrame([(g, r, low[a:b].tobytes(), flags[a:b].tobytes())
                             for r, a, b in cut(keys, keys >> np.uint64(32))],
                            columns=["g", "r", "keys", "flags"])

    return send


def _join_blocks(frame):
    """Which blocks are an anchor somewhere and occur more than once."""
    flags = joined(frame["flags"], np.uint8)

    def hit(order, runs):
        own = flags[order]
        times = np.add.reduceat(1 + (own >> 1).astype(np.int64), runs)
        return (np.bitwise_or.reduceat(own & 1, runs) > 0) & (times > 1), np.zeros(len(runs), np.uint8)

    r = int(frame["r"].iloc[0])
    return pd.DataFrame([(g, r, keys) for g, keys, _ in answer(frame, 4, hit)],
                        columns=["g", "r", "hits"])


def _send_windows(width, block, ranges):
    def send(frame, hits):
        out = pd.DataFrame(columns=["g", "r", "keys", "least", "several"])
        if not len(frame) or not len(hits):
            return out
        sought = np.sort(np.concatenate([
            np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(int(r) << 32)
            for r, k in zip(hits["r"], hits["hits"])]))
        group = Group(frame)
        at, found = group.windows(block)
        keys = ranged(found, ranges)
        place = np.minimum(np.searchsorted(sought, keys), len(sought) - 1)
        hit = at[sought[place] == keys]
        # a window that holds the block at p starts in [p + block - width, p]
        near = np.zeros(len(group.hashes) + 1, np.int64)
        np.add.at(near, np.maximum(hit + block - width, 0), 1)
        np.add.at(near, hit + 1, -1)
        at, found = group.windows(width)
        keep = np.cumsum(near)[at] > 0
        at, found = at[keep], found[keep]
        ids = group.ids[group.row[at]]
        order = np.lexsort((ids, found))
        found, ids = found[order], ids[order]
        runs = runs_of(found)
        if not len(runs):
            return out
        last = np.append(runs[1:], len(found)) - 1
        keys, least, several = found[runs], ids[runs], (ids[last] != ids[runs]).astype(np.uint8)
        upper = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        g = int(frame["g"].iloc[0])
        return pd.DataFrame([(g, r, keys[a:b].astype("<u8").tobytes(), least[a:b].astype("<i8").tobytes(),
                              several[a:b].tobytes()) for r, a, b in cut(keys, upper)],
                            columns=out.columns)

    return send


def _join_windows(frame):
    """The least document of each window that more than one document has."""
    least, several = joined(frame["least"], "<i8"), joined(frame["several"], np.uint8)

    def hit(order, runs):
        lengths = np.diff(np.append(runs, len(order)))
        more = (lengths > 1) | (np.bitwise_or.reduceat(several[order], runs) > 0)
        return more, np.minimum.reduceat(least[order], runs)

    return pd.DataFrame(answer(frame, 8, hit), columns=["g", "keys", "least"])


def _remove(width):
    def remove(frame, repeats):
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept"])
        group = Group(frame)
        cover = np.zeros(len(group.hashes) + 1, np.int64)
        if len(repeats):
            keys, least = joined(repeats["keys"], "<u8"), joined(repeats["least"], "<i8")
            order = np.argsort(keys)
            keys, least = keys[order], least[order]
            at, found = group.windows(width)
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            gone = at[(keys[place] == found) & (least[place] < group.ids[group.row[at]])]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        kept = []
        for text, a, b in zip(frame["text"], group.starts, group.ends):
            own = words(text)
            if gone[a:b].any():
                own = [w for w, out in zip(own, gone[a:b]) if not out]
            kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
        removed = np.concatenate(([0], np.cumsum(gone)))
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_words": group.sizes,
                             "n_removed": removed[group.ends] - removed[group.starts], "kept": kept})

    return remove


def remove_repeats(df: DataFrame, width: int = 50, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_words`, `n_removed` and the `kept` words, joined by one space, of every row.

    Windows are judged on the input. Null and empty texts and such of fewer words than the window
    lose nothing. Rows with equal ids are not smaller than each other and both stay; a null id counts
    as the largest. Other columns are not read.
    """
    if width < 2:
        raise ValueError("a window has at least two words")
    block = width // 2  # 2 * block - 1 <= width: each window holds a whole anchor
    ranges = parts_for(df, text, RANGE_CHARS)
    groups = parts_for(df, text, GROUP_CHARS)
    # rows without an id are dealt out by their text
    own = F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    docs = df.select(F.pmod(own, F.lit(groups)).alias("g"), F.col(key).cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("order_id"),
                     F.col(text).alias("text"))
    blocks = docs.groupBy("g").applyInPandas(
        _send_blocks(block, ranges), "g bigint, r bigint, keys binary, flags binary")
    hits = blocks.groupBy("r").applyInPandas(_join_blocks, "g bigint, r bigint, hits binary")
    around = docs.groupBy("g").cogroup(hits.groupBy("g")).applyInPandas(
        _send_windows(width, block, ranges),
        "g bigint, r bigint, keys binary, least binary, several binary")
    repeats = around.groupBy("r").applyInPandas(_join_windows, "g bigint, keys binary, least binary")
    return docs.groupBy("g").cogroup(repeats.groupBy("g")).applyInPandas(
        _remove(width), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
