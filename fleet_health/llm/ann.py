"""Approximate nearest neighbours by balanced posting lists.

Centroids come from splitting a bounded sample again and again until parts are small, which keeps
lists of similar length. A vector goes to its nearest list and, near a boundary, to further ones
within a distance ratio (closure). A graph over the centroids in memory finds the nearest lists; a
query reads those whose distance is within a ratio of the nearest's. Lists are read whole and scored
exactly.

The measure is the inner product: vectors get one more component that gives all the same length, in
which the largest inner product is the least distance.

Equal vectors are indexed once, with the smallest of their ids; more of them can be among nobody's
nearest. Long lists are cut into blocks by hash, so that a task holds a bounded number of vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleet_health.session import cut_lineage

#: Vectors that centroids are fitted on, at most.
SAMPLE = 50_000
#: Vectors of a list, about; with more than SAMPLE vectors, lists grow in proportion.
LIST = 128
#: Lists that a vector goes to at most, and the distance ratio for that.
REPLICAS, CLOSURE = 8, 1.3
#: Lists that a query reads at most, and the distance ratio for that.
PROBES, PRUNE = 64, 1.3
BRANCH, DEGREE, BEAM = 8, 16, 96
#: Beam of the search for the lists that keep a vector.
KEEP_BEAM = 24
BLOCK = 4096


def _nearest(points, centres):
    return (points @ centres.T * -2 + (centres**2).sum(1)).argmin(1)


def balanced_centroids(points: np.ndarray, part: int, seed: int = 0) -> np.ndarray:
    """Means of parts of at most about `part` points, by repeated balanced k-means splits."""
    rng, todo, out = np.random.default_rng(seed), [points], []
    while todo:
        own = todo.pop()
        k = min(BRANCH, -(-len(own) // part))
        if k < 2 or (own == own[0]).all():
            out.append(own.mean(0))
            continue
        centres = own[rng.choice(len(own), k, replace=False)]
        weight = np.zeros(k)
        for _ in range(12):
            cost = own @ centres.T * -2 + (centres**2).sum(1)
            side = (cost + weight * cost.std()).argmin(1)
            sizes = np.bincount(side, minlength=k)
            weight += 0.1 * (sizes * k / len(own) - 1)  # crowded parts become dearer
            for j in np.flatnonzero(sizes):
                centres[j] = own[side == j].mean(0)
        halves = [own[side == j] for j in range(k) if sizes[j]]
        if len(halves) == 1:
            halves = [own[: len(own) // 2], own[len(own) // 2 :]]
        todo += halves
    return np.array(out)


class Centroids:
    """Centroids and their neighbour graph, searched by beam for many points at once."""

    def __init__(self, centres: np.ndarray, longest: float, seed: int = 0):
        self.centres, self.longest = centres.astype(np.float32), longest
        self.square = (self.centres.astype(np.float64) ** 2).sum(1)
        n, links = len(centres), []
        degree = min(DEGREE, n - 1)
        for a in range(0, n, 1024):
            cost = self.square - 2 * (self.centres[a : a + 1024] @ self.centres.T)
            cost[np.arange(len(cost)), np.arange(a, a + len(cost))] = np.inf
            links.append(np.argpartition(cost, degree - 1, 1)[:, :degree] if degree else
                         np.zeros((len(cost), 0), np.int64))
        near = np.concatenate(links)
        # each centroid also links back to up to as many that chose it
        rows, ends = np.repeat(np.arange(n), degree), near.ravel()
        order = np.argsort(ends, kind="stable")
        ends, rows = ends[order], rows[order]
        place = np.arange(len(ends)) - np.searchsorted(ends, ends)
        back = np.repeat(np.arange(n)[:, None], degree, 1)
        few = place < degree
        back[ends[few], place[few]] = rows[few]
        self.links = np.concatenate([near, back], 1)
        self.entries = np.random.default_rng(seed).permutation(n)[:BEAM]

    def lengthened(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.longest**2 - (vectors.astype(np.float64) ** 2).sum(1)
        return np.hstack([vectors, np.sqrt(np.maximum(rest, 0))[:, None].astype(np.float32)])

    def search(self, points: np.ndarray, width: int = BEAM):
        """The beam of each point after the graph search: centroids and distances, nearest first."""
        beams = [self._search(points[a : a + 512], width) for a in range(0, len(points), 512)]
        return tuple(np.concatenate(x) for x in zip(*beams))

    def _search(self, points, width):
        n, rows = len(points), np.arange(len(points))
        base = (points.astype(np.float64) ** 2).sum(1)
        ids = np.repeat(self.entries[None], n, 0)
        cost = self.square[ids] - 2 * (points @ self.centres[self.entries].T)
        order = cost.argsort(1)[:, :width]
        ids, cost = np.take_along_axis(ids, order, 1), np.take_along_axis(cost, order, 1)
        width, done = ids.shape[1], np.zeros(ids.shape, bool)
        while True:
            waiting = np.where(done, np.inf, cost)
            at = waiting.argmin(1)
            go = np.isfinite(waiting[rows, at])
            if not go.any():
                break
            done[rows, at] = True
            new = self.links[ids[rows, at]]
            found = self.square[new] - 2 * np.einsum("nd,nkd->nk", points, self.centres[new])
            known = (new[:, :, None] == ids[:, None, :]).any(2)
            twice = (new[:, :, None] == new[:, None, :]) & np.tri(new.shape[1], k=-1, dtype=bool)
            found[known | twice.any(2) | ~go[:, None]] = np.inf
            ids = np.concatenate([ids, new], 1)
            cost = np.concatenate([cost, found], 1)
            done = np.concatenate([done, ~np.isfinite(found)], 1)
            order = np.argpartition(cost, width - 1, 1)[:, :width]
            ids, cost, done = (np.take_along_axis(x, order, 1) for x in (ids, cost, done))
        order = cost.argsort(1)
        cost = np.take_along_axis(cost, order, 1) + base[:, None]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(cost, 0))

    def closure(self, vectors):
        """(row, list) pairs: where each vector is kept."""
        ids, far = self.search(self.lengthened(vectors), KEEP_BEAM)
        near = (far <= CLOSURE * far[:, :1]) & np.isfinite(far)
        near[:, 0], near[:, REPLICAS:] = True, False
        row, place = np.nonzero(near)
        return row, ids[row, place]

    def lists(self, queries):
        """(row, list) pairs: which lists each query reads."""
        points = np.hstack([queries, np.zeros((len(queries), 1), np.float32)])
        ids, far = self.search(points)
        near = (far <= PRUNE * far[:, :1]) & np.isfinite(far)
        near[:, PROBES:] = False
        row, place = np.nonzero(near)
        return row, ids[row, place]


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float32) for x in column], np.float32)


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`id`, `vec` of the vectors that take part; of several lengths, the most frequent one does."""
    vec = F.col(vector).cast("array<float>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(
        F.col(key).cast("bigint").alias("id"), vec.alias("vec"), (good & some).alias("ok"))
    rows = rows.where("ok").drop("ok")
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def _merge_ids(k):
    def merge(frames):
        for frame in frames:
            names = [np.asarray(v, np.float32).tobytes() for v in frame["vec"]]
            frame = frame.assign(_name=names).sort_values("id")
            few = frame.drop_duplicates(["_name", "id"]).groupby("_name", sort=False).head(k)
            yield few[["id", "vec"]]

    return merge


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """`rep` (least id), `vec`, `ids` (the k least) of each different vector; hot ones in two steps."""
    zero = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)
                                              .cast("float")))
    few = zero.mapInPandas(_merge_ids(k), "id bigint, vec array<float>")
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)
    part = few.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(
        least(F.collect_list("id")).alias("ids"))
    whole = part.groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole.select(F.col("ids")[0].alias("rep"), "vec", "ids")


def _fill_lists(index):
    def fill(frames):
        for frame in frames:
            if len(frame):
                row, lists = index.value.closure(_matrix(frame["vec"]))
                out = frame.iloc[row].copy()
                out.insert(0, "list", lists.astype(np.int64))
                yield out

    return fill


def _choose_lists(index):
    def choose(frames):
        for frame in frames:
            if len(frame):
                row, lists = index.value.lists(_matrix(frame["vec"]))
                out = frame.iloc[row].copy()
                out.insert(0, "list", lists.astype(np.int64))
                yield out

    return choose


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, component after component: equal vectors score equally."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    out = np.zeros((len(q), len(v)))
    for d in range(q.shape[1]):
        out += np.multiply.outer(q[:, d], v[:, d])
    return out


def _read_lists(k):
    def read(asked: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(kept):
            kept = kept.sort_values("rep")
            own, reps, ids = _matrix(kept["vec"]), kept["rep"].to_numpy(), kept["ids"].to_numpy()
            for a in range(0, len(asked), 256):
                some = asked.iloc[a : a + 256]
                found = scores(_matrix(some["vec"]), own)
                top = np.argsort(-found, 1, kind="stable")[:, :k]
                out.append(pd.DataFrame({
                    "q": np.repeat(some["q"].to_numpy(), top.shape[1]), "rep": reps[top].ravel(),
                    "score": np.take_along_axis(found, top, 1).ravel(), "ids": ids[top].ravel()}))
        if not out:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64"), "ids": pd.Series(dtype=object)})
        return pd.concat(out)

    return read


def search(df: DataFrame, is_query, k: int = 20, *, key: str = "id", vector: str = "vector") -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest found of every row where `is_query` holds.

    Every valid row but the query itself is a candidate. Null, empty and zero vectors, such with null
    or non-finite components and those of an unusual length take no part, nor do rows without key.
    Rows of equal key and vector count once. Ties go to smaller ids. No valid row: no result.
    """
    spark = df.sparkSession
    rows = valid(df, key, vector)
    unique = cut_lineage(distinct_vectors(rows, k + 1))
    n, longest = unique.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    fields = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], fields)
    share = unique if n <= SAMPLE else unique.orderBy(F.xxhash64("rep")).limit(SAMPLE)
    points = _matrix(r[0] for r in share.select("vec").toLocalIterator())
    rest = np.sqrt(np.maximum(longest**2 - (points.astype(np.float64) ** 2).sum(1), 0))
    points = np.hstack([points, rest[:, None].astype(np.float32)])
    index = spark.sparkContext.broadcast(Centroids(balanced_centroids(points, LIST), longest))
    kept = cut_lineage(unique.repartition("rep").mapInPandas(
        _fill_lists(index), "list bigint, rep bigint, vec array<float>, ids array<bigint>"))
    blocks = kept.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    kept = kept.join(F.broadcast(blocks), "list").withColumn(  # at most SAMPLE lists
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), "vec").distinct()
    queries = queries.withColumn("vec", F.transform(
        "vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("float")))
    queries = queries.join(unique.select(F.col("rep").alias("q"), "vec"), "vec").select("query_id", "q")
    asked = unique.join(queries.select(F.col("q").alias("rep")).distinct(), "rep").select(
        F.col("rep").alias("q"), "vec")
    asked = (asked.repartition("q").mapInPandas(_choose_lists(index), "list bigint, q bigint, vec array<float>")
             .join(F.broadcast(blocks), "list")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    found = (asked.groupBy("list", "block").cogroup(kept.drop("blocks").groupBy("list", "block"))
             .applyInPandas(_read_lists(k + 1), "q bigint, rep bigint, score double, ids array<bigint>"))
    best = found.dropDuplicates(["q", "rep"]).select("q", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), "vec_id"]
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
    best = best.where(F.col("n") <= k + 1).drop("n")
    result = queries.join(best, "q").where("query_id <> vec_id")
    return result.select(
        "query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"),
        "vec_id", "score").where(F.col("rank") <= k)
