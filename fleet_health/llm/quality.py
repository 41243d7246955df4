"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

Each language has a model of order four over code points, trained on trusted documents. Four code
points are one 64-bit number, 16 bits each (code points from 65,534 on are one class, 0 stands before
the text), so contexts and suffixes are shifts and masks, and counts of all orders are joins of
sharded tables. One pass over the texts sends each slice's different 4-grams with their trusted
counts; the joins give every 4-gram that occurs anywhere its log probability; the table is written in
sorted shards by hash, which the scoring pass maps into memory.

A document is rejected when its perplexity exceeds its language's threshold: `SLACK` times a quantile
over trusted documents that took no part in training.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_health.llm.common import load_array, mix, open_store, save_array, slices
from fleet_health.llm.packed import cut
from fleet_health.session import cut_lineage, scratch_path

ORDER = 4
#: Of FOLDS folds of the trusted documents, one never trains; all that do not train set the thresholds.
FOLDS = 5
QUANTILE, SLACK = 0.99, 1.05
#: A language needs that many trusted documents that do not train, or the common threshold holds.
LEAST_TRUSTED = 30
#: Trusted documents that train, about, at most; None: all. Languages get equal parts; one with fewer gives all.
MAX_TRUSTED: int | None = None
#: 4-grams of one shard of the table, and keys of one shard of the training set, about.
SHARD = 500_000
#: Code points that a Python task works on at a time; each takes about 60 bytes meanwhile.
SLICE = 1_200_000
MASKS = {3: 2**48 - 1, 2: 2**32 - 1, 1: 2**16 - 1}


def grams(text: str) -> np.ndarray:
    """One number for each code point of the text and the three before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([np.zeros(3, np.uint64), np.minimum(codes, 65534).astype(np.uint64) + np.uint64(1)])
    out = np.zeros(len(codes) - 3, np.uint64)
    for i in range(ORDER):
        out = out << np.uint64(16) | codes[i : i + len(out)]
    return out


class Members:
    """The hashes of the keys that train, in sorted shards by hash; opened as they are asked for."""

    def __init__(self, folder: str, names: dict[int, str], ranges: int):
        self.folder, self.names, self.ranges, self.opened = folder, names, ranges, {}

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        keys, back = np.unique(hashes.view(np.uint64), return_inverse=True)
        found = np.zeros(len(keys), bool)
        for r, a, b in cut(keys, _range(keys, self.ranges)):
            if r in self.names:
                if r not in self.opened:
                    self.opened[r] = load_array(self.folder, f"{self.names[r]}.trains", "<u8")
                own = self.opened[r]
                found[a:b] = own[np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)] == keys[a:b]
        return found[back]


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _keep_members(folder):
    def keep(frame):
        name = uuid.uuid4().hex
        save_array(folder, f"{name}.trains", np.sort(frame["h"].to_numpy(np.int64).view(np.uint64)).astype("<u8"))
        return pd.DataFrame([(int(frame["r"].iloc[0]), name)], columns=["r", "name"])

    return keep


def _members(training: DataFrame, folder: str):
    """Writes the hashes of `key`; returns their shards' names, broadcast, and the number of ranges."""
    hashes = training.select(F.xxhash64("key").alias("h")).distinct()
    ranges = max(1, -(-training.count() // SHARD))
    upper = F.shiftrightunsigned("h", 32) * F.lit(ranges)
    stored = cut_lineage(hashes.withColumn("r", F.shiftright(upper, 32))
                         .groupBy("r").applyInPandas(_keep_members(folder), "r bigint, name string"))
    return training.sparkSession.sparkContext.broadcast({r["r"]: r["name"] for r in stored.collect()}), ranges


def _send(folder, shared, ranges):
    def send(frames):
        members = Members(folder, shared.value, ranges)
        for frame in slices(frames, limit=SLICE):
            frame = frame.assign(trains=frame["known"].to_numpy(bool) & members.hold(frame["h"].to_numpy(np.int64)))
            for lang, own in frame.groupby("lang", sort=False):
                found = [grams(t) for t in own["text"] if isinstance(t, str)]
                if found:
                    trains = np.repeat(own["trains"][own["text"].notna()].to_numpy(bool),
                                       [len(x) for x in found])
                    keys, back = np.unique(np.concatenate(found), return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "k4": keys.view(np.int64),
                                        "n": np.bincount(back, weights=trains, minlength=len(keys)).astype(np.int64)})

    return send


def _key(k: Column, order: int) -> Column:
    return k if order == ORDER else k.bitwiseAND(F.lit(MASKS[order]))


def _context(k: Column) -> Column:
    return F.shiftrightunsigned(k, 16)


def discounts(table: DataFrame) -> DataFrame:
    """`lang` and the three discounts of modified Kneser-Ney for n-grams seen once, twice and more often.

    Every language has its own, from how many of its n-grams occur once to four times.
    """
    times = table.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"_{i}") for i in range(1, 5)])
    n1, n2, n3, n4 = (F.col(f"_{i}") for i in range(1, 5))
    y = F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(F.lit(0.5))
    found = [F.when(low > 0, i - (i + 1) * y * F.try_divide(high, low)).otherwise(y)
             for i, (low, high) in enumerate([(n1, n2), (n2, n3), (n3, n4)], 1)]
    return times.select("lang", *[F.least(F.greatest(d, F.lit(0.05)), F.lit(float(i))).alias(f"_d{i}")
                                  for i, d in enumerate(found, 1)])


def model(counted: DataFrame) -> DataFrame:
    """`lang`, `k4`, `log_p` (natural) of each counted 4-gram (`n`: times in training, or 0).

    Languages without training text have no rows.
    """
    tables, own = {}, counted.where("n > 0").select("lang", F.col("k4").alias("k"), "n")
    for order in range(ORDER, 0, -1):
        tables[order] = own
        if order > 1:  # continuation counts: in how many ways an n-gram is preceded
            own = own.groupBy("lang", _key(F.col("k"), order - 1).alias("k")).agg(F.count("n").alias("n"))
    out = counted.join(F.broadcast(tables[1].groupBy("lang").agg(F.count("n").alias("types"))), "lang")
    p = 1.0 / (F.col("types") + 1)
    for order in range(1, ORDER + 1):
        discounted = tables[order].join(F.broadcast(discounts(tables[order])), "lang")
        cut_off = F.when(F.col("n") == 1, F.col("_d1")).when(F.col("n") == 2, F.col("_d2")).otherwise(F.col("_d3"))
        table = discounted.select("lang", "k", "n", cut_off.alias("_off"))
        contexts = (table.groupBy("lang", _context(F.col("k")).alias("_c")).agg(
            F.sum("n").alias("_sum"), F.sum("_off").alias("_cut")))
        table = table.select("lang", F.col("k").alias("_k"), (F.col("n") - F.col("_off")).alias("_less"))
        out = out.withColumn("_p", p).withColumn("_k", _key(F.col("k4"), order)).withColumn("_c", _context(F.col("_k")))
        out = out.join(contexts, ["lang", "_c"], "left").join(table, ["lang", "_k"], "left")
        mixed = F.coalesce("_less", F.lit(0.0)) / F.col("_sum") + F.col("_cut") / F.col("_sum") * F.col("_p")
        out = out.select("lang", "k4", "types", F.when(F.col("_sum").isNull(), F.col("_p")).otherwise(mixed).alias("_q"))
        p = F.col("_q")
    return out.select("lang", "k4", F.log("_q").alias("log_p"))


def _hash(lang: str, keys: np.ndarray) -> np.ndarray:
    import xxhash

    return mix(keys ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))


def _store(folder, ranges):
    def store(frame):
        found = np.concatenate([_hash(lang, own["k4"].to_numpy(np.int64).view(np.uint64))
                                for lang, own in frame.groupby("lang", sort=False)])
        values = np.concatenate([own["log_p"].to_numpy("<f4") for _, own in frame.groupby("lang", sort=False)])
        order = np.argsort(found)
        name = uuid.uuid4().hex
        save_array(folder, f"{name}.keys", found[order].astype("<u8"))
        save_array(folder, f"{name}.logs", values[order])
        return pd.DataFrame([(int(frame["r"].iloc[0]), name)], columns=["r", "name"])

    return store


def _hash_udf(ranges):
    def of(frames):
        for frame in frames:
            r = np.zeros(len(frame), np.int64)
            for lang, at in frame.groupby("lang", sort=False).indices.items():
                found = _hash(lang, frame["k4"].to_numpy(np.int64)[at].view(np.uint64))
                r[at] = _range(found, ranges).astype(np.int64)
            yield frame.assign(r=r)

    return of


def _score(folder, shared, ranges):
    def score(frames):
        names, mapped = shared.value, {}
        for frame in slices(frames, limit=SLICE):
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            found = [_hash(lang, grams(t)) if isinstance(lang, str) and t else np.empty(0, np.uint64)
                     for lang, t in zip(frame["lang"], texts)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            keys, back = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_inverse=True)
            logs = np.full(len(keys), np.nan)
            for r, a, b in cut(keys, _range(keys, ranges)):
                if r in names:
                    if r not in mapped:
                        mapped[r] = [load_array(folder, f"{names[r]}.{x}", k) for x, k in (("keys", "<u8"), ("logs", "<f4"))]
                    own, values = mapped[r]
                    at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                    logs[a:b] = np.where(own[at] == keys[a:b], values[at], np.nan)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(doc, weights=logs[back], minlength=len(sizes))
            with np.errstate(invalid="ignore", divide="ignore"):
                perplexity = np.exp(-total / sizes)
            out = frame.drop(columns=["text"])
            out["n_chars"] = [len(t) for t in texts]
            out["perplexity"] = [float(x) if np.isfinite(x) else None for x in perplexity]
            yield out

    return score


def _level(sizes: list[int], most: int) -> int:
    """The largest number such that the sizes, none counted beyond it, add up to `most` at most."""
    left = most
    for i, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= size
    return max(sizes, default=0)


def training_keys(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The different keys (`key`) of the trusted documents that train. `docs` has `key` and `lang`.

    Without the last fold; with MAX_TRUSTED, of the languages that have more than their part a share by hash.
    """
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("key")), F.lit(FOLDS))
    able = docs.where("lang IS NOT NULL").where(fold > 0).select("key", "lang").join(known, "key", "left_semi")
    if MAX_TRUSTED is None:
        return able.select("key").distinct()
    able = cut_lineage(able)
    sizes = {r["lang"]: r["count"] for r in able.groupBy("lang").count().collect()}
    level = _level(list(sizes.values()), MAX_TRUSTED)
    shares = [(lang, math.ceil(level / n * 2**30)) for lang, n in sizes.items() if n > level]
    if shares:
        shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share bigint"))
        part = F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(2**30))
        able = able.join(shares, "lang", "left").where(F.col("share").isNull() | (part < F.col("share")))
    return able.select("key").distinct()


def judge(df: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text",
          lang: str = "lang") -> DataFrame:
    """`doc_id`, `lang`, `perplexity`, `threshold`, `keep` of every row.

    `trusted` has the keys of trusted rows (nulls and repeats do not matter). All train but one fold,
    which sets the thresholds, by a join that has no texts: the model must not have seen these. The
    training keys go into files that the tasks map, as hashes of 64 bits (for bigint keys one to one),
    so the texts stay where they are. Null and empty texts
    have no perplexity and are rejected. A null language, or one without trusted text, has no model:
    its documents have no perplexity and are kept. Without any trusted document all are kept but
    those without text. Other columns are not read.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "quality")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    known = trusted.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    docs = df.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    training = cut_lineage(training_keys(docs, known))
    counted = (docs.where("lang IS NOT NULL")
               .select("lang", "text", F.xxhash64("key").alias("h"), F.col("key").isNotNull().alias("known"))
               .mapInPandas(_send(folder, *_members(training, folder)), "lang string, k4 bigint, n bigint")
               .groupBy("lang", "k4").agg(F.sum("n").alias("n")))
    table = cut_lineage(model(cut_lineage(counted)))
    ranges = max(1, -(-table.count() // SHARD))
    stored = cut_lineage(table.mapInPandas(_hash_udf(ranges), "lang string, k4 bigint, log_p double, r bigint")
                         .groupBy("r").applyInPandas(_store(folder, ranges), "r bigint, name string"))
    names = spark.sparkContext.broadcast({r["r"]: r["name"] for r in stored.collect()})
    fields = f"key {dict(df.dtypes)[key]}, lang string, n_chars bigint, perplexity double"
    scored = cut_lineage(docs.mapInPandas(
        _score(folder, names, ranges), fields))
    rest = known.join(training, "key", "left_anti")
    fold_docs = cut_lineage(scored.where("perplexity IS NOT NULL")
                            .select("key", "lang", "perplexity").join(rest, "key", "left_semi"))
    q = F.percentile_approx("perplexity", QUANTILE, 100_000) * SLACK
    common = fold_docs.agg(q).first()[0]
    own = fold_docs.groupBy("lang").agg(q.alias("threshold"), F.count(F.lit(1)).alias("n"))
    own = own.where(F.col("n") >= LEAST_TRUSTED).drop("n")
    out = scored.join(own, "lang", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(common).cast("double")))
    keep = F.when(F.col("n_chars") == 0, F.lit(False)).otherwise(
        F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select(F.col("key").alias("doc_id"), "lang", "perplexity", "threshold", keep.alias("keep"))
