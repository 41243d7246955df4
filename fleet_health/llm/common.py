"""What several operators share: words, hashes, packed rows and shared files."""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text characters that a Python task works on at a time.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """`bytes.split` and `bytes.lower` know exactly the six white-space characters and A-Z."""
    if not isinstance(text, str):
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all input bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive values."""
    if len(values) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(values) - width + 1, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    for i in range(width):
        out = out * base + values[i : i + len(out)]
    return mix(out)


def slices(frames, column: str = "text", limit: int = SLICE_CHARS):
    """Pandas frames cut into runs of rows with about `limit` characters, for bounded memory."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(np.int64) + 64
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield frame.iloc[a:b]


def parts_for(df: DataFrame, column: str, chars_each: float, least: int = 8,
              most: int = 200_000) -> int:
    """As many parts as give each about `chars_each` characters of the column; one small job."""
    total = df.agg(F.sum(F.length(column))).first()[0] or 0
    return int(min(most, max(least, math.ceil(total / chars_each))))


def local_path(uri: str) -> str | None:
    """The path of a folder that the nodes mount, or None for a store that only clients reach."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    ends = np.cumsum(counts)
    shift = np.repeat(starts - (ends - counts), counts)
    return shift + np.arange(len(shift))


def units(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut before single spaces: distinct units, the unit numbers in order, units per text.

    A cut never falls inside a match of the byte-level pretokenizer pattern, and no match looks
    beyond its unit, so units can be tokenized apart: a unit starts with a space that a
    non-space follows, and white space at its end is followed by just such a unit. Texts with a
    space before other white space or at the end are cut only between non-spaces. A mark at a unit's
    end after a letter is a unit of its own, since a match has letters or marks.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    odd, cut = re.compile(r" (?=\s|\Z)"), re.compile(r"(?<=\S) (?=\S)")
    texts, plain, other = list(texts), [], []
    for i, t in enumerate(texts):
        if isinstance(t, str) and t:
            (other if odd.search(t) else plain).append(i)
    found = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
    if other:
        cuts = pa.array([cut.split(texts[i]) for i in other], found.type)
        found = pa.concat_arrays([found, cuts]).take(pa.array(np.argsort(np.array(plain + other))))
    sizes = np.zeros(len(texts), np.int64)
    sizes[sorted(plain + other)] = np.diff(found.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    flat = found.flatten()
    first = np.zeros(len(flat), bool)
    first[starts[sizes > 0]] = True
    rest, head = (flat.filter(pa.array(x)).dictionary_encode() for x in (~first, first))
    codes = np.empty(len(first), np.int64)
    codes[~first] = rest.indices.to_numpy()
    codes[first] = head.indices.to_numpy().astype(np.int64) + len(rest.dictionary)
    space = [pa.scalar(x, pa.large_string()) for x in ("", " ")]
    found = pa.concat_arrays([pc.binary_join_element_wise(space[0], rest.dictionary, space[1]), head.dictionary])
    marked = pc.match_substring_regex(found, "[A-Za-z][,.;:!?]$")
    ends = found.filter(marked)
    stems = pc.if_else(marked, pc.utf8_slice_codeunits(found, 0, -1), found)
    distinct = pa.concat_arrays([stems, pc.utf8_slice_codeunits(ends, -1)]).dictionary_encode()
    own, marked = distinct.indices.to_numpy().astype(np.int64), marked.to_numpy(zero_copy_only=False)
    last = np.zeros(len(marked), np.int64)
    last[marked] = own[len(marked) :]
    times = 1 + marked[codes]
    made = np.repeat(own[codes], times)
    upto = np.concatenate(([0], np.cumsum(times)))
    made[upto[1:][times == 2] - 1] = last[codes[times == 2]]
    return distinct.dictionary.to_pylist(), made, upto[starts + sizes] - upto[starts]


class UnitCache:
    """Token ids of units, kept from slice to slice; of more than `most`, those used again stay."""

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self.known, self.ends, self.ids = {}, np.zeros(1, np.int64), np.empty(0, np.int32)
        self.used = np.empty(0, np.int32)

    def shrink(self):
        """Lets go of the units that one slice only used, and of the least used, to half of `most`."""
        least = 2
        if len(self.used) > self.most // 2:
            least = max(least, int(np.partition(self.used, -(self.most // 2) - 1)[-(self.most // 2) - 1]) + 1)
        keep, counts = self.used >= least, np.diff(self.ends)
        self.known = {w: i for i, w in enumerate(w for w, k in zip(self.known, keep.tolist()) if k)}
        self.ids = self.ids[np.repeat(keep, counts)]
        self.ends = np.concatenate(([0], np.cumsum(counts[keep])))
        self.used = self.used[keep] // 2

    def tokens(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids end, from 0."""
        distinct, code, sizes = units(texts)
        if len(self.known) > self.most:
            self.shrink()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            made = [distinct[i] for i in new]
            starts, ids = self.encode(made)
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(made, at[new].tolist()))
            self.ends = np.concatenate((self.ends, starts[1:] + self.ends[-1]))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int32)))
        self.used[at] += 1
        at = at[code]
        counts = self.ends[at + 1] - self.ends[at]
        ids = self.ids[spans(self.ends[at], counts)]
        per_unit = np.concatenate(([0], np.cumsum(counts)))
        return ids, per_unit[np.concatenate(([0], np.cumsum(sizes)))]


def open_store(folder: str):
    """A pyarrow file system and the folder's path in it; works for any store pyarrow knows."""
    from pyarrow import fs

    path = local_path(folder)
    if path is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(folder)


def save_array(folder: str, name: str, array: np.ndarray) -> None:
    store, path = open_store(folder)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(np.ascontiguousarray(array).data)


def load_array(folder: str, name: str, kind: str) -> np.ndarray:
    """Memory-mapped where the folder is mounted, read whole otherwise."""
    store, path = open_store(folder)
    if store.get_file_info(f"{path}/{name}").size == 0:
        return np.empty(0, kind)
    if local_path(folder) is not None:
        return np.memmap(f"{path}/{name}", kind, "r")
    return np.frombuffer(store.open_input_file(f"{path}/{name}").read(), kind)
