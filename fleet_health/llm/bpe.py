"""Byte-level BPE by merge rounds over padded matrices, and its inverse.

Pretokens of similar length form one matrix, a pretoken a row. In every round each row merges its
leftmost pair of least rank; since each live row then loses exactly one cell, one mask compacts the
matrix. Pair ranks come from an open-addressing hash table.

Ids travel packed: little-endian unsigned 32-bit numbers in one binary column.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.llm.common import UnitCache, slices, spans

NONE = np.int32(2**31 - 1)
#: Pretokens of more bytes are merged one by one with a heap, in n log n steps.
LONG = 192
#: Cells of one matrix at most.
CELLS = 2_000_000
#: Rows that are decoded before they are handed on.
DECODED_ROWS = 1000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """Pair ranks in a hash table of numpy arrays, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"ranks lack the bytes {missing}")
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                left, right = ranks.get(word[:i]), ranks.get(word[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(8, (2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot, self.probes = self._slots(todo), 0
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = todo[free]  # of several for one slot the last stays
            won = self.keys[slot] == todo
            self.values[slot[won]] = value[won]
            todo, value, slot = todo[~won], value[~won], (slot[~won] + 1) & (len(self.keys) - 1)
            self.probes += 1
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for word, rank in ranks.items():
            self.lengths[rank] = len(word)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        by_rank = sorted(ranks.items(), key=lambda item: item[1])
        self.bytes = np.frombuffer(b"".join(word for word, _ in by_rank), np.uint8)

    def _slots(self, keys):
        hashed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (hashed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it has none."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slots(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _matrix(self, words: list[bytes], width: int):
        """Ids of words of at most `width` bytes: for each word its number of ids, and all ids."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = np.arange(width) < lengths[:, None]
        cells = np.full((n, width), -1, np.int32)
        cells[inside] = self.first[flat]
        rank = np.full((n, max(width - 1, 0)), NONE, np.int32)
        both = inside[:, 1:]
        rank[both] = self.pairs(cells[:, :-1][both], cells[:, 1:][both])
        counts, out, live = lengths.copy(), np.full((n, width), -1, np.int32), np.arange(n)
        while len(live) and rank.shape[1]:
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            least = rank[row, at]
            ended = least == NONE
            if ended.any():
                out[live[ended], : cells.shape[1]] = cells[ended]
                go = ~ended
                live, cells, rank, at, least = live[go], cells[go], rank[go], at[go], least[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            cells[row, at] = least
            keep = np.ones(cells.shape, bool)
            keep[row, at + 1] = False
            cells = cells[keep].reshape(len(live), -1)
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(live), -1)
            counts[live] -= 1
            left = np.flatnonzero(at > 0)
            if len(left):
                a = at[left]
                rank[left, a - 1] = self.pairs(cells[left, a - 1], cells[left, a])
            right = np.flatnonzero(at + 1 < counts[live])
            if len(right):
                a = at[right]
                rank[right, a] = self.pairs(cells[right, a], cells[right, a + 1])
        if len(live):
            out[live, : cells.shape[1]] = cells
        return counts, out[np.arange(width) < counts[:, None]]

    def _long(self, word: bytes) -> list[int]:
        """One word with a heap of its pairs."""
        ids = [int(self.first[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        a = np.array(ids, np.int32)
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self.pairs(a[:-1], a[1:]))
                if r != NONE]
        heapq.heapify(heap)

        def push(i):
            j = after[i]
            if i >= 0 and j < len(ids):
                r = int(self.pairs(np.array([ids[i]]), np.array([ids[j]]))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def encode(self, words: list[bytes]):
        """Offsets of each word's ids (one more than words), and all ids in order."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        counts = np.zeros(len(words), np.int64)
        groups, at = [], 0
        while at < len(order):
            width = int(lengths[order[at]])
            if width > LONG:
                got = self._long(words[order[at]])
                counts[order[at]] = len(got)
                groups.append((order[at : at + 1], np.array(got, np.int32)))
                at += 1
                continue
            top = min(LONG, max(width + width // 4, 4))
            end = min(int(np.searchsorted(lengths[order], top, "right")), at + CELLS // top)
            rows = order[at:end]
            width = int(lengths[rows[-1]])
            if width:
                counts[rows], ids = self._matrix([words[i] for i in rows], width)
                groups.append((rows, ids))
            at = end
        starts = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(starts[-1], np.int32)
        for rows, ids in groups:
            out[spans(starts[rows], counts[rows])] = ids
        return starts, out

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes[spans(self.starts[ids], self.lengths[ids])].tobytes()


def _encoder(merges, pattern, text_col, id_col, count_col, decoded_col=None):
    def encode(frames):
        import regex

        split, own = regex.compile(pattern), merges.value

        def of_units(distinct):
            found = [split.findall(w) for w in distinct]
            ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
            flat = np.empty(ends[-1], object)
            flat[:] = [w for words in found for w in words]
            code, pretokens = pd.factorize(flat)
            starts, ids = own.encode([w.encode("utf-8") for w in pretokens])
            counts = np.diff(starts)[code]
            return np.concatenate(([0], np.cumsum(counts)))[ends], ids[spans(starts[code], counts)]

        cache = UnitCache(of_units, 150_000)
        for frame in slices(frames, text_col, 1_500_000):
            ids, ends = cache.tokens(frame[text_col])
            packed = ids.astype("<u4").tobytes()
            out = frame.drop(columns=[text_col])
            out[id_col] = [packed[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
            out[count_col] = np.diff(ends)
            if decoded_col:
                out[decoded_col] = [own.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in out[id_col]]
            yield out

    return encode


def _decoder(merges, id_col, out_col):
    def decode(frames):
        own = merges.value
        for frame in frames:
            for a in range(0, len(frame), DECODED_ROWS):
                part = frame.iloc[a : a + DECODED_ROWS]
                out = part.drop(columns=[id_col])
                out[out_col] = [None if x is None else own.decode(np.frombuffer(x, "<u4").astype(np.int64))
                                for x in part[id_col]]
                yield out

    return decode


def encode(df: DataFrame, rank_path: str, pattern: str, *, keys: list[str], text: str = "text",
           ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """`keys`, the packed ids and their number, for every row.

    A null or empty text has no ids. Special tokens are ordinary text. Texts of any length are
    encoded whole; rows and ties stay as they are, other columns are not read.
    """
    merges = df.sparkSession.sparkContext.broadcast(Merges(read_ranks(rank_path)))  # fixed size
    cut = df.select(*[F.col(k) for k in keys], F.col(text).alias("_text"))
    kinds = ", ".join([*(f"`{k}` {t}" for k, t in cut.dtypes if k != "_text"),
                       f"`{ids}` binary", f"`{count}` bigint"])
    return cut.mapInPandas(_encoder(merges, pattern, "_text", ids, count), kinds)


def round_trip(df: DataFrame, rank_path: str, pattern: str, *, keys: list[str], text: str = "text",
               ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded") -> DataFrame:
    """What `encode` gives, and the bytes that the packed ids decode to.

    One Python worker does both, slice by slice, so a task holds the merges once and the ids cross
    once. Rows are those of `encode`; a text without ids decodes to no bytes.
    """
    merges = df.sparkSession.sparkContext.broadcast(Merges(read_ranks(rank_path)))  # fixed size
    cut = df.select(*[F.col(k) for k in keys], F.col(text).alias("_text"))
    kinds = ", ".join([*(f"`{k}` {t}" for k, t in cut.dtypes if k != "_text"),
                       f"`{ids}` binary", f"`{count}` bigint", f"`{decoded}` binary"])
    return cut.mapInPandas(_encoder(merges, pattern, "_text", ids, count, decoded), kinds)


def decode(df: DataFrame, rank_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The bytes that packed ids stand for, in place of the ids; null ids give null."""
    merges = df.sparkSession.sparkContext.broadcast(Merges(read_ranks(rank_path)))
    kinds = ", ".join([*(f"`{k}` {t}" for k, t in df.dtypes if k != ids), f"`{out}` binary"])
    return df.mapInPandas(_decoder(merges, ids, out), kinds)
