"""Packed rows: sorted hashes of a group of documents, one row per group and hash range."""

from __future__ import annotations

import numpy as np


def ranged(found: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range in the upper half, 32 other bits of the hash in the lower."""
    upper = (found >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return upper << np.uint64(32) | found & np.uint64(0xFFFFFFFF)


def cut(keys: np.ndarray, upper: np.ndarray):
    """(range, start, end) of each run of equal `upper`."""
    if len(keys):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(upper)) + 1, [len(keys)]))
        yield from zip(upper[edges[:-1]].tolist(), edges[:-1], edges[1:])


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def joined(column, kind):
    return np.frombuffer(b"".join(column), kind)


def answer(frame, entry_bytes, hit):
    """Rows (g, order of its entries) for the entries of runs of equal keys where `hit` says so."""
    counts = frame["keys"].str.len().to_numpy() // entry_bytes
    g = np.repeat(frame["g"].to_numpy(np.int64), counts)
    keys = joined(frame["keys"], f"<u{entry_bytes}")
    order = np.argsort(keys, kind="stable")
    runs = runs_of(keys[order])
    good, value = hit(order, runs)
    lengths = np.diff(np.append(runs, len(keys)))
    chosen = order[np.repeat(good, lengths)]
    values = np.repeat(value, lengths)[np.repeat(good, lengths)]
    by = np.lexsort((keys[chosen], g[chosen]))
    chosen, values = chosen[by], values[by]
    return [(i, keys[chosen[a:b]].tobytes(), values[a:b].tobytes())
            for i, a, b in cut(chosen, g[chosen])]
