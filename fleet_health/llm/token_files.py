"""Token ids in flat binary files, with document offsets, in ascending document order.

A shard is three files, all little-endian: `<name>.tokens` (unsigned 16- or 32-bit ids, the
narrowest that holds the vocabulary), `<name>.offsets` (signed 64-bit, one more than documents:
where each document starts among ALL ids, so that the first is the shard's base) and `<name>.docs`
(signed 64-bit document ids; the last `n_null` of the manifest row stand for null and are 0). The bases are prefix sums over the shards' sizes.

Shards are ranges of document ids. A task writes under a name of its own and returns a manifest row;
only files that the manifest names count, so that a task that is run twice does no harm.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleet_health.llm.common import UnitCache, load_array, open_store, parts_for, slices, spans
from fleet_health.session import cut_lineage, scratch_path

MANIFEST = "shard string, least bigint, n_docs bigint, n_tokens bigint, width int, n_null bigint, tie bigint"
#: Units that go into one call of the tokenizers library.
BATCH = 500
#: Units whose ids a Python worker keeps, about.
KEPT = 1_000_000
#: A worker's cache, by the tokenizer's file and its time, for all tasks that the worker runs.
_CACHES: dict = {}


def _tokenizer(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _added(own) -> list[str]:
    """What the tokenizer's added tokens look like in a text."""
    return [t.content for t in own.get_added_tokens_decoder().values() if t.content]


def library_encoder(path: str):
    """Unit encoder by the tokenizers library: many units go as one string.

    Byte-level ids have known byte lengths, which tell where a unit's ids end. Units that do not
    start with a space go alone, since a cut before them would not be seen. Special tokens in a unit
    are spelled out.
    """
    own = _tokenizer(path)
    own.encode_special_tokens = True
    size = own.get_vocab_size(with_added_tokens=True)
    width = np.zeros(size, np.int64)
    for token, i in own.get_vocab(with_added_tokens=True).items():
        width[i] = len(token)  # one character stands for one byte

    def encode(found: list[str]):
        lengths = np.fromiter((len(w.encode("utf-8")) for w in found), np.int64, len(found))
        spaced = [i for i, w in enumerate(found) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        rest = sorted(set(range(len(found))) - set(spaced))
        order = np.array([*spaced, *rest], np.int64)
        joined = ["".join(found[i] for i in spaced[a : a + BATCH]) for a in range(0, len(spaced), BATCH)]
        joined += [found[i] for i in rest]
        got = [e.ids for e in own.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, np.int32), *[np.array(x, np.int32) for x in got]])
        ends = np.concatenate(([0], np.cumsum(width[ids])))
        marks = np.searchsorted(ends, np.concatenate(([0], np.cumsum(lengths[order]))))
        if (ends[marks] != np.concatenate(([0], np.cumsum(lengths[order])))).any():
            raise ValueError("token lengths do not add up to the text; not a byte-level tokenizer")
        counts = np.diff(marks)
        starts = np.empty(len(found), np.int64)
        starts[order], per = marks[:-1], np.empty(len(found), np.int64)
        per[order] = counts
        return np.concatenate(([0], np.cumsum(per))), ids[spans(starts, per)]

    return encode


def _cache(path: str) -> UnitCache:
    of = path, os.path.getmtime(path)
    if of not in _CACHES:
        _CACHES.clear()
        _CACHES[of] = UnitCache(library_encoder(path), KEPT)
    return _CACHES[of]


def _whole(own, texts, holds, ids, ends):
    """`ids` and `ends` with the ids of the texts that `holds` names, which have none there yet."""
    got = [np.array(e.ids, np.int64) for e in own.encode_batch_fast([texts[i] for i in holds], add_special_tokens=False)]
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    more = np.zeros(len(ends), np.int64)
    more[np.array(holds) + 1] = sizes
    return np.insert(ids, np.repeat(ends[holds], sizes), np.concatenate(got)), ends + np.cumsum(more)


def _writer(folder, tokenizer_path, end_id, kind, added_tokens):
    def write(frames):
        from contextlib import ExitStack

        cache, store, base, own, added = None, None, 0, None, []
        least, tie, n_docs, n_null, name = None, None, 0, 0, uuid.uuid4().hex
        with ExitStack() as stack:
            files = {}
            for frame in slices(frames):
                if cache is None:
                    cache = _cache(tokenizer_path)
                    if added_tokens:
                        own = _tokenizer(tokenizer_path)
                        added = _added(own)
                    store, path = open_store(folder)
                    for suffix in ("tokens", "offsets", "docs"):
                        files[suffix] = stack.enter_context(
                            store.open_output_stream(f"{path}/{name}.{suffix}"))
                    tie = int(frame["tie"].iloc[0])
                    if not frame["no_id"].iloc[0]:
                        least = int(frame["doc_id"].iloc[0])
                    files["offsets"].write(np.zeros(1, "<i8").tobytes())
                texts = list(frame["text"])
                holds = [i for i, t in enumerate(texts) if isinstance(t, str) and any(a in t for a in added)]
                if holds:  # an added token may stand across a cut
                    apart = list(texts)
                    for i in holds:
                        apart[i] = None
                    ids, ends = _whole(own, texts, holds, *cache.tokens(apart))
                else:
                    ids, ends = cache.tokens(texts)
                out = np.insert(ids, ends[1:], end_id).astype(kind)
                ends = ends[1:] + np.arange(1, len(ends))
                files["tokens"].write(out.tobytes())
                files["offsets"].write((base + ends).astype("<i8").tobytes())
                files["docs"].write(frame["doc_id"].to_numpy("<i8").tobytes())
                base += len(out)
                n_docs += len(frame)
                n_null += int(frame["no_id"].sum())
        if n_docs:
            out = pd.DataFrame([(name, least, n_docs, base, np.dtype(kind).itemsize, n_null, tie)],
                               columns=["shard", "least", "n_docs", "n_tokens", "width", "n_null", "tie"])
            yield out.astype({"least": "Int64", "tie": "Int64"})

    return write


def write(df: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, *,
          added_tokens: bool = False, null_ids: bool = False) -> DataFrame:
    """Write all documents (`doc_id`, `text`) and return the manifest, with each shard's base.

    `added_tokens`: the tokenizer's added tokens that stand in a text become their own ids, as the
    library does unless told otherwise; else special ones are spelled out.
    Null or empty texts have the end id alone. Rows with a null doc_id cannot be addressed by id: with
    `null_ids` they come last, by a hash of their text, else they are refused. Repeated doc_ids are
    all written, next to each other, by a hash of their text. Offsets in the files count from the shard's start; the manifest's `base` makes them global.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    top = max([end_id, _tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1])
    kind = "<u2" if top < 2**16 else "<u4"
    none = F.col("doc_id").isNull()
    instead = F.lit(0).cast("bigint") if null_ids else F.raise_error(F.lit("a document has no doc_id")).cast("bigint")
    docs = df.select(
        F.when(none, instead).otherwise(F.col("doc_id").cast("bigint")).alias("doc_id"),
        F.col("text").cast("string"), none.alias("no_id"),
        # rows without id or with equal ids have an order, and are no single range
        F.xxhash64(F.col("text").cast("string")).alias("tie"))
    order = ["no_id", "doc_id", "tie"]
    sorted_docs = docs.repartitionByRange(parts_for(df, "text", 40e6), *order).sortWithinPartitions(*order)
    shards = cut_lineage(sorted_docs.mapInPandas(_writer(folder, tokenizer_path, end_id, kind, added_tokens), MANIFEST))
    before = Window.orderBy(F.col("least").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.select(*[c for c in shards.columns if c != "tie"], F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"),
                         F.lit(folder).alias("folder"))


def open_shard(folder: str, shard: str, width: int):
    """Ids, offsets and document ids of one shard; memory-mapped where the folder is mounted."""
    return [load_array(folder, f"{shard}.{suffix}", kind)
            for suffix, kind in (("tokens", f"<u{width}"), ("offsets", "<i8"), ("docs", "<i8"))]


def _reader(frames):
    for frame in frames:
        for row in frame.itertuples():
            ids, offsets, docs = open_shard(row.folder, row.shard, row.width)
            for a in range(0, len(docs), 2000):
                b = min(a + 2000, len(docs))
                cuts = np.asarray(offsets[a : b + 1])
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(np.array(docs[a:b], np.int64),
                                                     np.arange(a, b) >= len(docs) - row.n_null),
                    "start": row.base + cuts[:-1],
                    "ids": [np.asarray(ids[i:j]).astype("<u4").tobytes()
                            for i, j in zip(cuts, cuts[1:])]})


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """`doc_id`, `start` and the packed 32-bit `ids` of every document, from the files."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInPandas(
        _reader, "doc_id bigint, start bigint, ids binary")
