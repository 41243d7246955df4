"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents with the same set of sources form one pattern. Each source has a quota of words; a pattern
may give its words once at no cost, a second time at cost 1, a third time at cost 2, and so on
(convex repetition costs). The flow that fills the quotas at least cost says how many words each
pattern gives: whole repetitions, and a rest that a seeded choice of documents makes up.

The choice is made inside size classes (powers of two), each by a prefix in the order of a seeded
hash, found from sums over hash ranges; what the prefixes leave open is filled from the next few
documents of each class, largest first. So no group of documents is ever ordered in one task.
"""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleet_health.llm.common import WORD
from fleet_health.llm.components import components
from fleet_health.operators.ordering import with_place
from fleet_health.session import cut_lineage

#: Documents in one hash range, about.
RANGE_DOCS = 2000
#: Documents of each class that may fill what the prefixes leave open.
FILLERS = 4
#: Classes of all patterns up to which tables with a few rows for each are broadcast.
BROADCAST_CLASSES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rotating_weights(sizes: DataFrame) -> DataFrame:
    """`sizes` with `weight`: 1, 2, 3, 1, ... for the sources by code point, null last."""
    one = sizes.withColumn("_one", F.lit(0))
    return with_place(one, "_one", [F.col("source").isNull(), F.col("source")]).select(
        *sizes.columns, (F.col("place") % 3 + 1).cast("double").alias("weight"))


def _weighed(sizes: DataFrame, weigh) -> DataFrame:
    if weigh is None:
        return rotating_weights(sizes)
    own = weigh.select("source", F.col("weight").cast("double").alias("weight"))
    return sizes.join(own.withColumnRenamed("source", "_own"), F.col("source").eqNullSafe(F.col("_own")), "left").select(
        *sizes.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"))


def targets(sizes: DataFrame, most: float) -> DataFrame:
    """`sizes` (source, source_size, weight) with `target`: shares of the sum of all sizes by weight.

    None is above `most` times its source's size: what lies above is shared again by weight among
    those below, until none is above. The driver sees one row of sums for each time.
    """
    total, whole = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    left, known, limit = float(total or 0), 0, F.lit(float(most)) * F.col("source_size")
    capped, share = F.lit(False), F.lit(0.0)
    while whole:
        share = F.lit(left) * F.col("weight") / F.lit(whole)
        capped = share > limit
        n, held, rest = sizes.agg(F.count_if(capped), F.sum(F.when(capped, F.col("source_size"))),
                                  F.sum(F.when(~capped, F.col("weight")))).first()
        if n <= known:
            break
        known, left, whole = n, float(total - most * held), rest
        share = F.lit(0.0)
    return sizes.withColumn("target", F.when(capped, limit).otherwise(share))


def flow(capacity: list[int], members: list[list[int]], quota: list[int], most: int):
    """Words that pattern p gives to source s, as {(p, s): words}; least repetition cost.

    A path's cost is that of the repetition it starts with, so filling repetition after repetition,
    each with a largest flow, takes paths in the order of their costs: the sum of costs is least.
    """
    given: dict[tuple[int, int], int] = {}
    need = list(quota)
    holders: list[set[int]] = [set() for _ in quota]
    for _ in range(most):
        left = list(capacity)
        for p, own in enumerate(members):  # paths of one step need no search
            for s in own:
                amount = min(left[p], need[s])
                if amount:
                    given[p, s] = given.get((p, s), 0) + amount
                    holders[s].add(p)
                    left[p] -= amount
                    need[s] -= amount
        while True:
            came: dict[tuple[str, int], tuple[str, int] | None] = {
                ("p", p): None for p, x in enumerate(left) if x > 0}
            todo, end = deque(came), None
            while todo and end is None:
                kind, i = todo.popleft()
                if kind == "p":
                    for s in members[i]:
                        if ("s", s) not in came:
                            came["s", s] = ("p", i)
                            if need[s] > 0:
                                end = ("s", s)
                                break
                            todo.append(("s", s))
                else:
                    for p in holders[i]:
                        if ("p", p) not in came:
                            came["p", p] = ("s", i)
                            todo.append(("p", p))
            if end is None:
                break
            path, at = [end], came[end]
            while at is not None:
                path.append(at)
                at = came[at]
            path.reverse()
            steps = list(zip(path, path[1:]))
            amount = min([left[path[0][1]], need[end[1]],
                          *[given[b[1], a[1]] for a, b in steps if a[0] == "s"]])
            for a, b in steps:
                p, s, sign = (a[1], b[1], 1) if a[0] == "p" else (b[1], a[1], -1)
                given[p, s] = given.get((p, s), 0) + sign * amount
                (holders[s].add if given[p, s] else holders[s].discard)(p)
            left[path[0][1]] -= amount
            need[end[1]] -= amount
        if not any(need):
            break
    return {k: v for k, v in given.items() if v}


def _solve(most: int):
    """The flow of one component: rows of patterns (`amount`: words) and of sources (their quota)."""
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        sources, patterns = frame[~frame["is_pattern"]], frame[frame["is_pattern"]]
        at = {json.loads(x)[0]: i for i, x in enumerate(sources["item"])}
        given = flow(patterns["amount"].tolist(), [[at[s] for s in json.loads(x)] for x in patterns["item"]],
                     sources["amount"].tolist(), most)
        total = [0] * len(patterns)
        for (p, _), words in given.items():
            total[p] += words
        return pd.DataFrame({"_pattern": patterns["item"].to_numpy(), "_given": total})

    return solve


def _node(source: Column) -> Column:
    """A number for a source's name; equal numbers of two names only join their components."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), source), F.lit("")))


def _given(patterns: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """`_pattern`, `_given`: the words that each pattern with a source gives.

    A pattern of one source that no other pattern shares gives what the source needs and it has.
    Sources that patterns connect are a component, and its flow is solved in one task.
    """
    first = F.col("_members")[0]
    alone = lambda rows, own: rows.where(F.size("_members") == 1).join(
        own, first.eqNullSafe(F.col("source"))).select(
            "_pattern", F.least(F.col("quota"), F.col("_all") * most).alias("_given"))
    overlapping = patterns.where(F.size("_members") > 1)
    if overlapping.isEmpty():
        return alone(patterns, goals)
    label = components(overlapping.select(
        _node(first).alias("a"), F.explode(F.transform("_members", _node)).alias("b")))
    goals = goals.withColumn("node", _node(F.col("source"))).join(label, "node", "left")
    tied = patterns.where(F.size("_members") > 0).withColumn("node", _node(first)).join(label, "node")
    sent = tied.selectExpr("label", "_pattern AS item", "_all AS amount", "true AS is_pattern").unionByName(
        goals.where("label IS NOT NULL").select(
            "label", F.to_json(F.array("source")).alias("item"), F.col("quota").alias("amount"),
            F.lit(False).alias("is_pattern")))
    solved = sent.groupBy("label").applyInPandas(_solve(most), "_pattern string, _given bigint")
    return alone(patterns, goals.where("label IS NULL")).unionByName(solved)


def plan(totals: DataFrame, weigh, most: int) -> tuple[DataFrame, DataFrame]:
    """(sources with sizes and targets, what each class of each pattern gives), from rows of
    `_pattern`, `_cls`, `_words`, `_docs`."""
    patterns = cut_lineage(totals.groupBy("_pattern").agg(F.sum("_words").alias("_all"))
                           .withColumn("_members", F.from_json("_pattern", "array<string>")))
    sizes = cut_lineage(patterns.select(F.explode("_members").alias("source"), "_all").groupBy("source")
                        .agg(F.sum("_all").alias("source_size")))
    goals = cut_lineage(targets(cut_lineage(_weighed(sizes, weigh)), most)
                        .withColumn("quota", F.floor(F.col("target") + 0.5)))
    given = patterns.select("_pattern", "_all").join(_given(patterns, goals, most), "_pattern", "left").select(
        "_pattern", "_all", F.coalesce("_given", F.lit(0)).alias("_given"))
    some = F.col("_all") > 0
    quotas = totals.join(given, "_pattern").withColumns({
        "_full": F.when(some, F.expr("_given div _all")).otherwise(1),
        "_rest": F.when(some, F.col("_given") % F.col("_all")).otherwise(0)}).select(
            "_pattern", "_cls", "_full", "_rest",
            F.when(some, F.expr("cast(_rest AS decimal(19, 0)) * cast(_words AS decimal(19, 0)) div _all"))
            .otherwise(0).alias("_quota"),
            F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.lit(1), "_docs") / RANGE_DOCS))))
            .cast("int").alias("_bits"))
    return goals.select("source", "source_size", "target"), cut_lineage(quotas)


def small_side(frame: DataFrame) -> DataFrame:
    """A table with a few rows for each source or class: broadcast after a check of its size."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_CLASSES else frame


def _filler(most):
    """Closes what the prefixes leave open: documents once more, whole classes, documents again.

    Rows of place 0 are classes (`size`: their words), the others are documents; `had` is how often
    one is taken already (a class's documents: at most).
    """
    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        left, times = int(frame["open"].iloc[0]), dict.fromkeys(frame.index, 0)
        frame = frame[frame["size"] > 0].sort_values(["size", "cls", "place"], ascending=[False, True, True])
        docs, classes = frame[frame["place"] > 0], frame[frame["place"] == 0]
        extra: dict[int, int] = {}

        def add(row, once=False):
            nonlocal left
            free = most - row.had - times[row.Index] - (extra.get(row.cls, 0) if row.place else 0)
            n = max(0, min(left // row.size, free, 1 if once else free))
            times[row.Index] += n
            left -= n * row.size
            return n

        for row in docs[docs["had"] == docs["least"]].itertuples():
            add(row, once=True)
        again = {c: max([times[i] + h for i, h in zip(own.index, own["had"])], default=0)
                 for c, own in docs.groupby("cls")}
        for row in classes.itertuples():
            extra[row.cls] = add(row._replace(had=max(row.had, again.get(row.cls, 0))))
        for row in docs.itertuples():
            add(row)
        rest = [r for r in docs.itertuples() if r.had + times[r.Index] + extra.get(r.cls, 0) < most]
        if rest and rest[-1].size < 2 * left:  # nearer with the smallest than without
            times[rest[-1].Index] += 1
        out = frame.loc[[i for i in frame.index if times[i]], ["pattern", "cls", "place"]]
        return out.assign(times=[times[i] for i in out.index])

    return fill


def mix(df: DataFrame, *, id: str = "doc_id", text: str = "text", sources: Column | None = None,
        weigh: DataFrame | None = None, most: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): every row of `df` with `mix_size` (words), `mix_copies` and `mix_taken`
    (words taken, repeats counted), and a table of each source's size and target.

    `sources` is an array of names (default: the column `source` alone); a null name is a source of
    its own, an empty array or null takes no part (0 copies). `weigh` is a table of `source` and
    `weight`, one row a source, 0 where it has none; without it sources weigh 1, 2, 3, repeating, by
    code point. Null and empty texts have no words; they are repeated like their pattern's whole
    repetitions. Rows with equal ids are separate documents. Ties in the seeded order are broken by
    id, size and a hash of the text; what is still equal is interchangeable. Columns of `df` with the
    added names are replaced. Sources and targets of an empty table are empty. There may be any
    number of sources and patterns; patterns that share sources, directly or by others, are solved
    in one task.
    """
    members = F.array("source") if sources is None else F.array_sort(F.array_distinct(sources))
    keep = [c for c in df.columns if c not in ("mix_size", "mix_copies", "mix_taken")]
    measures = [
        F.coalesce(F.to_json(members), F.lit("[]")).alias("_pattern"),
        word_count(F.col(text)).alias("mix_size"), F.col(id).alias("_id"),
        F.xxhash64(F.lit(seed), F.col(text)).alias("_tie"),
        # rows without an id are told apart by their text
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id).cast("string"), F.when(F.col(id).isNull(), F.col(text))), 1)
        .alias("_hash")]
    cls = F.length(F.bin("mix_size"))
    # what the plan needs is read from the texts once
    narrow = cut_lineage(df.select(*measures).withColumn("_cls", cls))
    totals = cut_lineage(narrow.groupBy("_pattern", "_cls").agg(
        F.sum("mix_size").alias("_words"), F.count(F.lit(1)).alias("_docs")))
    source_frame, quota_frame = plan(totals, weigh, most)
    # all others have a row for each (pattern, class) at most, or a few; beyond the bound Spark decides
    few = quota_frame.count() <= BROADCAST_CLASSES
    per_class = F.broadcast if few else (lambda frame: frame)
    group = ["_pattern", "_cls"]

    def ranged(sized):
        return sized.join(per_class(quota_frame), group, "left").withColumn(
            "_range", F.expr("shiftrightunsigned(_hash, 63 - _bits)"))

    upto = Window.partitionBy(*group).orderBy("_range")
    sums = (ranged(narrow).groupBy(*group, "_range", "_quota", "_rest", "_full")
            .agg(F.sum("mix_size").alias("_sum"))
            .withColumn("_upto", F.sum("_sum").over(upto)))
    cut = cut_lineage(sums.where("_upto > _quota")
                      .groupBy(*group).agg(F.min("_range").alias("_cut"),
                                           F.min(F.col("_upto") - F.col("_sum")).alias("_before")))
    order = Window.partitionBy(*group).orderBy("_hash", "_id", "mix_size", "_tie")

    def inside_of(placed):
        return placed.where("_range = _cut").select(
            "*", F.row_number().over(order).alias("_place"),
            (F.col("_before") + F.sum("mix_size").over(
                order.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("_quota")).alias("_fits"))

    small = inside_of(ranged(narrow).join(per_class(cut), group, "left")).select(
        "_pattern", "_cls", "_place", "mix_size", "_fits", "_before")
    reached = (small.groupBy(*group).agg(
        (F.max("_before") + F.coalesce(F.sum(F.when(F.col("_fits"), F.col("mix_size"))), F.lit(0)))
        .alias("_got")))
    whole = sums.groupBy(*group, "_rest", "_full").agg(F.sum("_sum").alias("_all"))
    open_ = (whole.join(reached, group, "left").groupBy("_pattern", "_rest")
             .agg(F.sum(F.coalesce("_got", "_all")).alias("_got"))
             .select("_pattern", (F.col("_rest") - F.col("_got")).alias("open")))
    after = Window.partitionBy(*group, "_fits").orderBy("_place")
    candidates = (small.withColumn("_n", F.row_number().over(after)).where(F.col("_n") <= FILLERS)
                  .join(whole.select(*group, "_full"), group)
                  .selectExpr("_pattern", "_cls", "_place", "mix_size AS _size", "_full AS _least",
                              "_full + int(_fits) AS _had")
                  .unionByName(whole.selectExpr("_pattern", "_cls", "0 AS _place", "_all AS _size",
                                                "_full AS _least", "_full + 1 AS _had")))
    chosen = cut_lineage(candidates.join(open_, "_pattern").where("open > 0")
              .selectExpr("_pattern AS pattern", "_cls AS cls", "_place AS place", "_size AS size",
                          "_least AS least", "_had AS had", "open")
              .groupBy("pattern").applyInPandas(
                  _filler(most), "pattern string, cls int, place int, times bigint")
              .selectExpr("pattern AS _pattern", "cls AS _cls", "place AS _place", "times AS _times"))
    fills = chosen.where("_place > 0").withColumnRenamed("_times", "_fill")
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), *measures).withColumn("_cls", cls)
    placed = ranged(wide).join(per_class(cut), group, "left")
    outside = placed.where("_cut IS NULL OR _range <> _cut").select(
        "*", (F.col("_cut").isNull() | (F.col("_range") < F.col("_cut"))).alias("_in"))
    inside = inside_of(placed)
    inside = inside.join(per_class(fills), [*group, "_place"], "left")
    again = per_class(chosen.where("_place = 0").drop("_place"))
    inside, outside = inside.join(again, group, "left"), outside.join(again, group, "left")
    copies = lambda more, fill=F.lit(0): (
        F.when(F.col("_pattern") == "[]", F.lit(0))
        .otherwise(F.col("_full") + more.cast("int") + F.coalesce("_times", F.lit(0)) + fill)).cast("bigint").alias("mix_copies")
    out = outside.select("_row", "mix_size", copies(F.col("_in") & (F.col("_rest") > 0))).unionByName(
        inside.select("_row", "mix_size", copies(F.col("_fits") & (F.col("_rest") > 0), F.coalesce("_fill", F.lit(0)))))
    out = out.select(*[F.col(f"_row.`{c}`") for c in keep], "mix_size", "mix_copies",
                     (F.col("mix_size") * F.col("mix_copies")).alias("mix_taken"))
    return out, source_frame
