"""Global order statistics without a global sort in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleet_health.session import cut_lineage

BUCKETS = 1024
SKETCH = 10_000
#: Distinct values that one task may rank.
IN_ONE_TASK = 100_000


def running_totals(points: DataFrame, key: str, sums: Sequence[str], descending: bool = True,
                   buckets: int = BUCKETS) -> DataFrame:
    """Add `cum_<s>` (through this row) and `total_<s>` for distinct, ordered keys.

    Rows go to at most `buckets` key ranges of about equal size; totals of the ranges are summed up
    first, and windows then run inside the ranges. The ranges only balance the work: any choice of
    bounds gives the same sums.
    """
    steps = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    bounds = points.agg(F.array_distinct(F.percentile_approx(
        key, F.expr(f"array({steps})"), 10 * buckets)).alias("_bounds"))
    ranged = points.crossJoin(F.broadcast(bounds)).select(*points.columns, F.size(
        F.filter("_bounds", lambda b: b <= F.col(key))).alias("_range"))
    order = F.desc if descending else F.asc
    # One row per range, so at most `buckets` rows meet in these windows.
    per_range = ranged.groupBy("_range").agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    before = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_in_{s}").over(before), F.lit(0)).alias(f"_off_{s}")
                    for s in sums],
        *[F.sum(f"_in_{s}").over(everything).alias(f"total_{s}") for s in sums])
    inside = (Window.partitionBy("_range").orderBy(order(key))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(F.broadcast(offsets), "_range").select(
        *points.columns,
        *[(F.col(f"_off_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums],
        *[f"total_{s}" for s in sums])


def _bracket(x: DataFrame, first: int, second: int, below: int, rows: int, sketch: int) -> tuple:
    """Two values of `x` around the places `first` and `second`, `below` being the rows before x."""
    near = [max(0.0, (first - below) / rows - 2 / sketch), min(1.0, (second + 1 - below) / rows + 2 / sketch)]
    return x.agg(F.percentile_approx("_x", F.array(*[F.lit(s) for s in near]), sketch)).first()[0]


def exact_percentile(rows: DataFrame, value: str, share: float, name: str = "percentile",
                     sketch: int = SKETCH, most: int = IN_ONE_TASK) -> DataFrame:
    """One row: the exact percentile with linear interpolation; null where there is no value.

    The built-in exact aggregate keeps every distinct value in one place. Here the rank is bracketed
    again and again: a sketch proposes two values around it, one count tells how many rows lie below
    and inside, and the next round looks only inside. At most `most` distinct values are ranked in
    the end, whatever the table's size; each round keeps about 4 / sketch of the rows. A sketch that
    misses is noticed by the counts, and its side stays as wide as it was. The rounds are small jobs.
    """
    x = rows.select(F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    total, low, high = x.agg(F.count(F.lit(1)), F.min("_x"), F.max("_x")).first()
    kind = x.schema["_x"].dataType
    if not total:
        return x.agg(F.max("_x").cast("double").alias(name))
    rank = share * (total - 1)
    first, second = math.floor(rank), math.ceil(rank)
    below, inside = 0, total
    while True:
        held = x.where(F.col("_x").between(F.lit(low).cast(kind), F.lit(high).cast(kind)))
        if inside <= most or low == high:
            break
        a, b = _bracket(held, first, second, below, inside, sketch)
        cut = [F.lit(v).cast(kind) for v in (a, b)]
        less, upto = held.agg(F.count_if(F.col("_x") < cut[0]), F.count_if(F.col("_x") <= cut[1])).first()
        before = below, inside, low, high
        if below + upto > second:
            inside, high = upto, b
        if below + less <= first:
            below, inside, low = below + less, inside - less, a
        if (below, inside, low, high) == before:
            # Equal values keep it wide, or the sketch is too coarse.
            if held.select("_x").distinct().limit(most + 1).count() <= most:
                break
            sketch *= 10
    near = held.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    # At most `most` rows meet in this window.
    upto = F.lit(below) + F.sum("_n").over(
        Window.orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = near.withColumn("_end", upto).agg(
        F.min(F.when(F.col("_end") > first, F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_end") > second, F.col("_x"))).alias("_b"))
    return ends.select((F.col("_a") + (F.col("_b") - F.col("_a")) * F.lit(rank - first)).alias(name))


def with_place(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Add `place`, the 0-based position of each row in its group, without a group in one task.

    Rows are sorted over ranges that cut groups where they like; what a group has in earlier ranges is
    one small row each. `order` must tell all rows of a group apart, or equal rows be alike.
    """
    # Written, so that row numbers stay the same whenever a task runs again.
    placed = cut_lineage(rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
                         .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33))
    pieces = placed.groupBy(group, "_part").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    return placed.join(pieces, [group, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"))


def with_test_flag(rows: DataFrame, key: Column, stratum: str, seed: int = 42) -> DataFrame:
    """Add `is_test`: the fifth of each class whose keys hash lowest, rounded up.

    The share is exact per class, (n + 4) div 5 rows. Instead of ranking a class in one task, rows
    are counted per hash prefix, and only the prefix where the share ends is ranked. What is
    broadcast is one row per class and prefix, then one row per class; classes must be few.
    """
    hashed = rows.select(F.col(stratum).alias("_class"),
                         F.md5(F.concat(key, F.lit(f"|{seed}"))).alias("_hash"))
    prefix = F.substring("_hash", 1, 3)
    counts = hashed.groupBy("_class", prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    in_class = Window.partitionBy("_class")
    upto = in_class.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.floor((F.sum("_n").over(in_class) + 4) / 5)
    ends = (counts.withColumn("_wanted", wanted).withColumn("_upto", F.sum("_n").over(upto))
            .where((F.col("_upto") >= F.col("_wanted"))
                   & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
            .select("_class", "_prefix", (F.col("_wanted") - F.col("_upto") + F.col("_n"))
                    .alias("_take")))
    nth = F.row_number().over(Window.partitionBy("_class").orderBy("_hash"))
    last = (hashed.withColumn("_prefix", prefix).join(F.broadcast(ends), ["_class", "_prefix"])
            .withColumn("_nth", nth).where(F.col("_nth") == F.col("_take"))
            .select(F.col("_class"), F.col("_hash").alias("_last")))
    mine = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return (rows.join(F.broadcast(last), F.col(stratum) == F.col("_class"), "left")
            .select(*rows.columns, F.coalesce(mine <= F.col("_last"), F.lit(False))
                    .alias("is_test")))
