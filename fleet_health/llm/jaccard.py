"""Documents linked by the Jaccard similarity of their word n-grams, by partition signatures.

For a similarity of p/q, two sets of a and b n-grams differ in at most k = (a + b)(q - p)/(q + p) of
them. Level L serves pairs with k in (2^(L-1), 2^L]: it cuts the domain of n-gram hashes into more
than 2^L parts, and the contents of one non-empty part are one signature. At most k parts differ, so
two similar sets share at least m - k of the m signatures of either. A set takes part in the levels
that its partners' sizes can lead to, one or two. Where a set has no more than k non-empty parts
(a few of the smallest), its single n-grams are signatures too.

Since m - k signatures are shared, in any common order a set needs only its first k + 1 ones. The
order is by the number of sets that hold a signature: a set with k + 1 signatures of its own has no
partner and is done, and signatures of passages that many documents share come last and drop out.

Documents with equal sets form a class and are one node. In a group of equal signatures the members
are first compared to one of them, that with the most shared signatures; then, what that did not
bring into one component is compared in blocks, which emit only links that connect what was apart. So
all links between components are tested. Comparisons are exact, on the sets of hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.llm.common import mix, parts_for, rolling, word_hashes, words
from fleet_health.llm.components import components
from fleet_health.llm.packed import answer, cut, joined, ranged, runs_of
from fleet_health.session import cut_lineage, scratch_path

GROUP_CHARS, RANGE_CHARS = 4e6, 16e6
#: Parts beyond 5/4 of a level's differences.
MORE_PARTS = 64
NO_ID = 2**63 - 1


class Sets:
    """The n-gram sets of a group's documents, in one run of hashes, ascending within a document."""

    def __init__(self, texts, n: int):
        hashes = [word_hashes(words(t, lower=True)) for t in texts]
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        flat = np.concatenate([np.empty(0, np.uint64), *hashes])
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        found = rolling(flat, n)
        whole = np.arange(len(found)) + n <= ends[doc[: len(found)]]
        # of fewer words than n, the whole sequence is one n-gram
        few = np.flatnonzero((sizes > 0) & (sizes < n))
        short = np.array([rolling(hashes[i], len(hashes[i]))[0] + np.uint64(len(hashes[i])) for i in few], np.uint64)
        found = np.concatenate([found[whole], short])
        doc = np.concatenate([doc[: len(whole)][whole], few])
        order = np.lexsort((found, doc))
        found, doc = found[order], doc[order]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        self.grams, self.doc = found[keep], doc[keep]
        self.sizes = np.bincount(self.doc, minlength=len(sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def names(self) -> list[bytes]:
        """16 bytes that name each document's set."""
        sums = np.zeros((len(self.sizes), 2), "<u8")
        some = self.sizes > 0
        if some.any():
            for i, salt in enumerate((0, 0xA5A5A5A5A5A5A5A5)):
                sums[some, i] = np.add.reduceat(mix(self.grams ^ np.uint64(salt)), self.starts[some])
        raw = sums.tobytes()
        return [raw[i : i + 16] for i in range(0, len(raw), 16)]

    def signatures(self, p: int, q: int, chosen: np.ndarray):
        """(document, signatures, how many of the first ones are needed) arrays, a level at a time.

        Only documents where `chosen` holds. A document's signatures of a level lie together.
        """
        n = self.sizes
        least = np.maximum(1, (n + -(-n * p // q)) * (q - p) // (q + p))
        most = (n + n * q // p) * (q - p) // (q + p)
        first = np.ceil(np.log2(least)).astype(np.int64)
        last = np.where(chosen & (most > 0), np.ceil(np.log2(np.maximum(most, 1))).astype(np.int64), -1)
        for step in range(int((last - first).max(initial=-1)) + 1):
            level = first + step
            own = level <= last
            at = np.flatnonzero(own[self.doc])
            if not len(at):
                continue
            grams, doc = self.grams[at], self.doc[at]
            parts = (1 << level) + (1 << level) // 4 + MORE_PARTS
            part = (grams >> np.uint64(32)) * parts[doc].astype(np.uint64) >> np.uint64(32)
            new = np.ones(len(at), bool)
            new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
            starts = np.flatnonzero(new)
            salt = level.astype(np.uint64) << np.uint64(48)
            made = mix(np.add.reduceat(mix(grams ^ np.uint64(0x5555555555555555)), starts)
                       ^ mix(part[starts] | salt[doc[starts]]))
            rows = doc[starts]
            k = np.minimum(1 << level, most)
            count = np.bincount(rows, minlength=len(n))
            needed = np.where(own, k + 1, 0)
            weak = own & (count <= k)
            if weak.any():  # their single n-grams too, and all are needed
                more = weak[doc]
                made = np.concatenate([made, mix(grams[more] ^ mix(salt[doc[more]] | np.uint64(1 << 40)))])
                rows = np.concatenate([rows, doc[more]])
                order = np.argsort(rows, kind="stable")
                made, rows = made[order], rows[order]
                needed = np.where(weak, count + n, needed)
            yield rows, made, needed


def _send(n, p, q, ranges):
    def send(frame):
        sets = Sets(frame["text"], n)
        first = {}
        for i, name in enumerate(sets.names()):
            first.setdefault(name, i)
        chosen = np.zeros(len(frame), bool)
        chosen[list(first.values())] = True
        found = [made for _, made, _ in sets.signatures(p, q, chosen)]
        if not found:
            return pd.DataFrame(columns=["g", "r", "keys", "counts"])
        keys, counts = np.unique(ranged(np.concatenate(found), ranges), return_counts=True)
        g, low, times = int(frame["g"].iloc[0]), keys.astype("<u4"), np.minimum(counts, 255).astype(np.uint8)
        return pd.DataFrame([(g, r, low[a:b].tobytes(), times[a:b].tobytes())
                             for r, a, b in cut(keys, keys >> np.uint64(32))],
                            columns=["g", "r", "keys", "counts"])

    return send


def _join(frame):
    """How many sets hold each signature, where more than one does."""
    counts = joined(frame["counts"], np.uint8)

    def hit(order, runs):
        total = np.add.reduceat(counts[order].astype(np.int64), runs)
        return total > 1, total.astype("<i4")

    r = int(frame["r"].iloc[0])
    return pd.DataFrame([(g, r, k, v) for g, k, v in answer(frame, 4, hit)],
                        columns=["g", "r", "keys", "counts"])


def _choose(n, p, q, ranges):
    def choose(frame, held):
        size = len(frame)
        if not size:
            return pd.DataFrame(columns=["order_id", "n", "name", "weight", "signatures", "grams"])
        sets = Sets(frame["text"], n)
        rows, chosen = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        shared, total = np.zeros(size), np.zeros(size)
        if len(held):
            keys = np.concatenate([np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(int(r) << 32)
                                   for r, k in zip(held["r"], held["keys"])])
            counts = joined(held["counts"], "<i4")
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            for doc, made, needed in sets.signatures(p, q, np.ones(size, bool)):
                sought = ranged(made, ranges)
                place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
                times = np.where(keys[place] == sought, counts[place], 1)
                order = np.lexsort((made, times, doc))
                doc, made, times = doc[order], made[order], times[order]
                lead = np.arange(len(doc)) - np.searchsorted(doc, doc)
                take = (lead < needed[doc]) & (times > 1)
                rows.append(doc[take])
                chosen.append(made[take])
                shared += np.bincount(doc, weights=np.log2(times), minlength=size)
                total += np.bincount(doc, minlength=size)
        rows, chosen = np.concatenate(rows), np.concatenate(chosen).view(np.int64)
        order = np.argsort(rows, kind="stable")
        rows, chosen = rows[order], chosen[order]
        edges = np.searchsorted(rows, np.arange(size + 1))
        grams, ends = sets.grams.view(np.int64), np.append(sets.starts, len(sets.grams))
        none = np.empty(0, np.int64)
        return pd.DataFrame({
            "order_id": frame["order_id"].to_numpy(), "n": sets.sizes, "name": sets.names(),
            "weight": shared / np.maximum(total, 1),
            "signatures": [chosen[a:b] for a, b in zip(edges, edges[1:])],
            "grams": [grams[ends[i] : ends[i + 1]] if edges[i] < edges[i + 1] else none for i in range(size)]})

    return choose


#: Nodes of one block of a family, about, and tasks that small families share.
BLOCK, SMALL_TASKS = 1024, 256
#: Narrow rows (a few numbers) that are broadcast at most; more of them are shuffled.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _tested(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough; few of the sets are a pair's second."""
    pairs = cut_lineage(pairs)
    seconds = cut_lineage(pairs.select(F.col("b").alias("node")).distinct())
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("left"))
    right = sets.join(_small(seconds), "node").select(F.col("node").alias("b"), F.col("grams").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - both
    return left.join(_small(pairs), "a").join(right, "b").where(both * q >= union * p).select("a", "b")


def _counts(grams: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets share."""
    size = len(grams)
    flat = np.concatenate(grams)
    who = np.repeat(np.arange(size), [len(x) for x in grams])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    starts = runs_of(flat)
    lengths = np.diff(np.append(starts, len(flat)))
    out = np.zeros((size, size), np.int32)
    for length in np.unique(lengths[lengths > 1]):
        own = starts[lengths == length]
        if length <= 16:
            for a in range(0, len(own), 100_000):
                m = who[own[a : a + 100_000, None] + np.arange(length)]
                at = m[:, :, None] * size + m[:, None, :]
                out += np.bincount(at.ravel(), minlength=size * size).reshape(size, size).astype(np.int32)
        else:
            for start in own:
                m = who[start : start + length]
                out[m[:, None], m] += 1
    return out


def _links_between(p, q):
    """Links that join different labels, of sets of one family; enough of them to connect these."""
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in frame.groupby("family", sort=False):
            if own["label"].nunique() < 2:
                continue
            grams = [np.asarray(x, np.int64) for x in own["grams"]]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            both = _counts(grams).astype(np.int64)
            label = own["label"].to_numpy()
            good = np.triu(both * q >= (sizes[:, None] + sizes - both) * p, 1)
            good &= label[:, None] != label
            parent = {x: x for x in label}
            node = own["node"].to_numpy()
            for i, j in zip(*np.nonzero(good)):
                x, y = label[i], label[j]
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                while parent[y] != y:
                    parent[y] = parent[parent[y]]
                    y = parent[y]
                if x != y:
                    parent[y] = x
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return compare


def _compared(rows: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Links between nodes of different labels that share a signature; `first` is one of its nodes.

    Nodes that signatures connect are a family. A family is cut into blocks by hash, and every two
    blocks are compared in one task, by an inverted index over their n-grams; no pairs are emitted
    but links that connect what was apart. Small families share tasks.
    """
    rows = cut_lineage(rows.distinct())
    family = components(rows.select(F.col("node").alias("a"), F.col("first").alias("b")))
    nodes = rows.select("node", "label").distinct().join(family.withColumnRenamed("label", "family"), "node")
    sizes = nodes.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    nodes = cut_lineage(nodes.join(sizes, "family").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    with_grams = sets.join(_small(nodes), "node").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = [F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(SMALL_TASKS)))
            .otherwise(F.col("family")).alias("task"),
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            (F.col("blocks") > 1).alias("large")]
    dealt = with_grams.select("node", "label", "family", "grams", *task)
    return cut_lineage(dealt.groupBy("task", "low", "high", "large").applyInPandas(
        _links_between(p, q), "a bigint, b bigint"))


def link(df: DataFrame, *, n: int = 5, p: int = 75, q: int = 100, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` of every row; q * intersection >= p * union links.

    `component_id` is the least id reachable by links, the row's own included. Null and empty texts
    and such without words have the empty set and are linked with nothing. Rows with equal sets are
    linked, whatever their ids; a null id counts as the largest and is never a component's name but
    for rows that are linked with null ids only, where it is null. Other columns are not read.
    """
    if not 0 < p <= q:
        raise ValueError("the similarity is above 0 and at most 1")
    ranges, groups = parts_for(df, text, RANGE_CHARS), parts_for(df, text, GROUP_CHARS)
    # rows without an id are dealt out by their text
    own = F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    docs = df.select(F.pmod(own, F.lit(groups)).alias("g"),
                     F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("order_id"),
                     F.col(text).alias("text"))
    sent = docs.groupBy("g").applyInPandas(_send(n, p, q, ranges), "g bigint, r bigint, keys binary, counts binary")
    held = sent.groupBy("r").applyInPandas(_join, "g bigint, r bigint, keys binary, counts binary")
    path = scratch_path(df.sparkSession, "jaccard")  # a table, so that unread columns cost nothing
    docs.groupBy("g").cogroup(held.groupBy("g")).applyInPandas(
        _choose(n, p, q, ranges), "order_id bigint, n int, name binary, weight double, "
        "signatures array<bigint>, grams array<bigint>").write.parquet(path)
    members = df.sparkSession.read.parquet(path)
    classes = cut_lineage(members.where("n > 0").groupBy("name", "n").agg(F.min("order_id").alias("node")))
    candidates = members.where(F.size("signatures") > 0)
    nodes = cut_lineage(candidates.select("name", "n").distinct().join(classes, ["name", "n"]).select("node"))
    firsts = candidates.withColumnRenamed("order_id", "node").join(_small(nodes), "node")
    sets = firsts.select("node", "grams")
    held = firsts.select("node", "n", "weight", F.explode("signatures").alias("s"))
    # one member of each group stands for it: the one with the most shared signatures
    heads = held.groupBy("s").agg(F.max_by("node", F.struct("weight", "node")).alias("head"))
    star = held.join(heads, "s").where("node <> head").groupBy("node", "head").count()
    best = star.groupBy("node").agg(F.max(F.struct("count", F.col("head"))).alias("m"))
    links = cut_lineage(_tested(best.select(F.col("node").alias("a"), F.col("m.head").alias("b")), sets, p, q))
    label = components(links)
    known = held.join(label, "node", "left").select("s", "node", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y"),
                                   F.min("node").alias("first")).where("x <> y").select("s", "first")
    more = _compared(known.join(mixed, "s").select("node", "label", "first"), sets, p, q)
    label = components(links.unionByName(more))
    named = classes.join(label, "node", "left").select(
        "name", "n", F.coalesce("label", "node").alias("label"))
    out = members.select("order_id", "n", "name").join(named, ["name", "n"], "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("order_id")).alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"),
                      real(F.coalesce("label", "order_id")).alias("component_id"))
