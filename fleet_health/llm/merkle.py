"""A Merkle manifest of a dataset: binary hash trees per group, and one over their roots.

The manifest stores records from a digest to its children. A record covers a segment of up to
2 ** DIGIT leaves of its tree and DIGIT levels, so the children are those at the segment's foot, and
a path of 30 levels takes three lookups. Records are found by content, that is by digest.

A request is a leaf's rank in its tree. It descends from the root by the digits of its rank: at each
record the digit selects a child, and the children that are not selected on the way there are the
siblings; they are collected from the top down and reversed, segment by segment. Requests under one
node descend together as one row, so the root is looked up once, not once per request.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text, and travel as
32 bytes. Every two consecutive nodes have one parent; a last odd node has a parent of its own.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleet_health.session import cut_lineage

#: Levels of the tree that a record covers.
DIGIT = 10
#: Rows of digests in one sorted partition.
ROWS_EACH = 200_000
#: The tree over the trees.
FOREST = "forest"


def encoded(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)), 256))


def _h(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _levels(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and the `height` levels above them."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def _height(count: int) -> int:
    """Levels above `count` nodes of one tree, within a segment."""
    return min(DIGIT, (count - 1).bit_length())


def _split(packed: bytes) -> list[bytes]:
    return [packed[i : i + 32] for i in range(0, len(packed), 32)]


def ranked(df: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """`rank` of each row in its tree, from 0, and `size` of the tree; no tree is sorted in one task.

    Rows are sorted over partitions that cut trees where they like; what a tree has in earlier
    partitions is one small row each.
    """
    # Written, since row numbers of partitions must not change when a task is run again.
    rows = df.count()
    dealt = df.repartitionByRange(max(1, math.ceil(rows / ROWS_EACH)), F.col(tree), *order)
    placed = cut_lineage(dealt.sortWithinPartitions(F.col(tree), *order)
                         .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33))
    pieces = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    in_tree = Window.partitionBy(tree)
    before = in_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(tree, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"),
                           F.sum("_n").over(in_tree).alias("size"))
    return (placed.join(pieces, [tree, "_part"])
            .select(*df.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "size"))


RECORD = "tree string, size bigint, segment bigint, digest binary, children binary"


def _record(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("rank")
    found = list(nodes["digest"])
    count = int(nodes["size"].iloc[0])
    top = _levels(found, _height(count))[-1][0]
    return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "size": count, "segment": nodes["rank"].iloc[0] >> DIGIT,
                         "digest": [top], "children": [b"".join(found)]})


def build(nodes: DataFrame) -> list[DataFrame]:
    """The records of each level of segments, from the leaves up, written to the shared folder.

    `nodes` has tree, rank, size and digest. The last level's records are the roots, one per tree
    that reaches it; shorter trees have theirs lower, where `size` is at most 2 ** DIGIT.
    """
    levels = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most:
        grouped = nodes.withColumn("_segment", F.shiftright("rank", DIGIT)).groupBy("tree", "_segment")
        levels.append(cut_lineage(grouped.applyInPandas(lambda rows: _record(rows), RECORD)))
        if most <= 1 << DIGIT:
            break
        above = F.ceil(F.col("size") / (1 << DIGIT)).cast("bigint")
        nodes = (levels[-1].where(F.col("size") > 1 << DIGIT)
                 .select("tree", F.col("segment").alias("rank"), above.alias("size"), "digest"))
        most = -(-most // (1 << DIGIT))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, its root's digest, and the number of the level of segments that it tops."""
    out = None
    for i, level in enumerate(levels):
        top = level.where(F.col("size") <= 1 << DIGIT).select("tree", "digest", F.lit(i).alias("level"))
        out = top if out is None else out.unionByName(top)
    return out


def _siblings(children: list[bytes], height: int):
    """For child i: the nodes beside its path through the segment, from the bottom up."""
    levels = _levels(children, height)

    def of(i: int) -> bytes:
        down = []  # collected on the way from the top to the child
        for j in range(height - 1, -1, -1):
            beside = (i >> j) ^ 1
            if beside < len(levels[j]):
                down.append(levels[j][beside])
        return b"".join(reversed(down))

    return of


def _step(names: list[str], carried: list[str]):
    """Cogrouped: the record at a node with the path so far, and the rows that descend through it."""

    def step(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(wanted):
            return pd.DataFrame(columns=names)
        at = found.iloc[0]
        children = _split(at["children"])
        beside = _siblings(children, _height(int(at["size"])))
        digits = (wanted["rank"].to_numpy() & ((1 << DIGIT) - 1)).tolist()
        paths = {d: beside(d) + at["path"] for d in set(digits)}
        out = wanted.copy()
        out["digest"] = [children[d] for d in digits]
        out["path"] = [paths[d] for d in digits]
        for c in carried:
            out[c] = [at[c]] * len(out)
        return out[names]

    return step


def descend(levels: list[DataFrame], starts: DataFrame, requests: DataFrame, payload: list[str],
            carried: tuple[str, ...] = ()) -> DataFrame:
    """`requests` (tree, rank and `payload`) with their leaf's `digest` and `path`.

    `starts` has tree, digest and level of each root, the `path` above it, and columns that all
    requests below get (`carried`). The path is the siblings from the leaf up, packed. Requests for
    ranks that do not exist are not asked for.
    """
    types = {**dict(starts.dtypes), **dict(requests.dtypes)}
    frontier = None
    for k in range(len(levels) - 1, -1, -1):
        here = starts.where(F.col("level") == k).select("tree", F.lit(0).cast("bigint").alias("node"), "digest", "path", *carried)
        if frontier is not None:
            here = here.unionByName(frontier.select("tree", F.col("rank").alias("node"), "digest", "path", *carried))
        # Equal content has one record, whatever number of places refer to it.
        records = levels[k].groupBy("digest").agg(F.first(F.struct("size", "children")).alias("_r"))
        found = here.join(records, "digest").select("tree", "node", "path", "_r.size", "_r.children", *carried)
        extra = payload if k == 0 else []
        wanted = requests.select("tree", F.shiftright("rank", DIGIT * k).alias("rank"), *extra)
        if k:
            wanted = wanted.distinct()
        wanted = wanted.withColumn("node", F.shiftright("rank", DIGIT))
        kinds = {"tree": "string", "rank": "bigint", **{c: types[c] for c in (*extra, *carried)}, "digest": "binary", "path": "binary"}
        frontier = (found.groupBy("tree", "node").cogroup(wanted.groupBy("tree", "node"))
                    .applyInPandas(_step(list(kinds), list(carried)), ", ".join(f"{c} {t}" for c, t in kinds.items())))
        if k:
            frontier = cut_lineage(frontier)
    return frontier


def fold(leaf: bytes, path: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings give; `places` has (rank, size) in each tree on the way."""
    beside, at = _split(path), 0
    for rank, size in places:
        while size > 1:
            if rank ^ 1 < size:
                leaf = _h(beside[at], leaf) if rank & 1 else _h(leaf, beside[at])
                at += 1
            else:
                leaf = _h(leaf)
            rank, size = rank >> 1, (size + 1) >> 1
    return leaf


def tree_name(group: Column) -> Column:
    """A name whose bytewise order is that of the groups, null first."""
    value = group.cast("string")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value))


class Manifest:
    """Records of the trees of all groups and of the forest over them, and the leaves' places."""

    def __init__(self, df: DataFrame, leaf: Column, group: str, key: str, payload: dict[str, Column]):
        """Leaves ascend by `key`, nulls last, then by digest. `payload` is carried to the proofs."""
        leaves = cut_lineage(df.select(tree_name(F.col(group)).alias("tree"), F.col(key).alias("_key"),
                                       leaf.alias("digest"), *[c.alias(n) for n, c in payload.items()]))
        self.payload = list(payload)
        self.leaves = cut_lineage(ranked(leaves, "tree", [F.col("_key").asc_nulls_last(), F.col("digest")]))
        self.levels = build(self.leaves.select("tree", "rank", "size", "digest"))
        self.empty = not self.levels
        if self.empty:
            return
        self.subroots = roots(self.levels)
        named = self.subroots.select(F.lit(FOREST).alias("tree"), F.col("tree").alias("name"), "digest", "level")
        self.trees = cut_lineage(ranked(named, "tree", [F.col("name")]))
        self.forest = build(self.trees.select("tree", "rank", "size", "digest"))
        self.root = roots(self.forest).first()["digest"]

    def proofs(self) -> DataFrame:
        """Every leaf with its `path` to the root, `subroot` and its place in both trees.

        Columns: key (as text, since pandas has no integers with nulls), digest, payload, path, subroot,
        rank, size, tree_rank, trees.
        """
        top = roots(self.forest).withColumn("path", F.unhex(F.lit("")))
        trees = descend(self.forest, top, self.trees.select("tree", "rank", "name", "level"), ["name", "level"])
        starts = trees.select(F.col("name").alias("tree"), "digest", "level", "path", F.col("digest").alias("subroot"),
                              F.col("rank").alias("tree_rank"))
        requests = self.leaves.select("tree", "rank", F.col("_key").cast("string").alias("_key"), "size", *self.payload)
        # The subroot rides down with the path: a join by tree would put a large tree into one task.
        below = descend(self.levels, cut_lineage(starts), requests, ["_key", "size", *self.payload], ("subroot", "tree_rank"))
        return below.withColumn("trees", F.lit(self.trees.agg(F.max("size")).first()[0]))


def _verified(rows):
    for frame in rows:
        proof, folded = [], []
        for r in frame.itertuples(index=False):
            proof.append(hashlib.sha256(r.path.hex().encode()).hexdigest())
            places = [(r.rank, r.size), (r.tree_rank, r.trees)]
            folded.append(fold(r.presented, r.path, places).hex())
        yield pd.DataFrame({"_key": frame["_key"], "leaf": frame["digest"].map(bytes.hex), "subroot": frame["subroot"].map(bytes.hex),
                            "proof_sha256": proof, "folded_root": folded})


def verify(df: DataFrame, leaf: Column, presented: Column, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether the presented leaf folds to the root.

    Nulls in any column have their own encoding; rows without a key come last in their group, and
    rows with equal keys follow each other by digest. Equal rows are leaves of their own. An empty
    table gives no rows. `leaf` and `presented` are digests of 32 bytes.
    """
    made = Manifest(df, leaf, group, key, {"presented": presented})
    kind = dict(df.dtypes)[key]
    shape = "_key string, leaf string, subroot string, proof_sha256 string, folded_root string"
    if made.empty:
        out = df.sparkSession.createDataFrame([], shape)
        root = F.lit(None).cast("string")
    else:
        out = made.proofs().mapInPandas(_verified, shape)
        root = F.lit(made.root.hex())
    return out.select(F.col("_key").cast(kind).alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == root).alias("verified"))
