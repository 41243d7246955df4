"""Ordered work on long machine histories, without putting one machine into one task.

A window partitioned by machine needs the whole history of a machine in a single task. That is fine
for most machines and impossible for one that holds a large part of all rows. So machines above a
row limit ("long" machines) are cut at points in time into segments of about that many rows, and
every window here is partitioned by (machine, segment). Three things make the result exact:

* each segment also receives the last `halo` rows of the segment before it, so trailing frames and
  lags of up to `halo` rows see what they need;
* those borrowed rows carry their true row number and run length, worked out from one small row set
  per segment, so running counts continue across segments;
* borrowed rows are marked, and leave the result at the end.

Machines below the limit have the single segment 0 and no borrowed rows. When no machine is long,
adaptive execution finds the cut table empty and drops the extra branch before it scans anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleet_health.schema import CODE, TIME

SEGMENT = "_segment"
LAST_SEGMENT = "_last_segment"
BORROWED = "_borrowed"
TRUE_ROW = "_true_row"
TRUE_RUN = "_true_run"
ROW = "_row"
RUN = "_run"
FAULT = "_fault"
RUL = "_rul"

MAX_ROWS = 1_000_000
# At most this many segments come from long machines, whatever the table size: the row limit grows
# with the table. It bounds the cut table, which is broadcast, to a few megabytes.
MAX_SEGMENTS = 100_000
MARKS_PER_SEGMENT = 64


def cut_points(rows: DataFrame, halo: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """(machine, sorted cut times) for long machines only; fewer than MAX_SEGMENTS cuts in all.

    Cuts are equally deep, not equally wide: they are every n-th of the machine's own reading times,
    after thinning these by hash. A segment holds at least `halo` rows, since at least that many
    thinned times lie between two cuts. Thinning only places the cuts; no reading is dropped.
    """
    marks = max(halo, min(MARKS_PER_SEGMENT, max_rows))
    sizes = rows.groupBy(CODE).agg(F.count(F.lit(1)).alias("_n"))
    limit = sizes.agg(
        F.greatest(F.lit(max_rows), F.ceil(F.sum("_n") / MAX_SEGMENTS)).alias("_limit"))
    long_machines = (sizes.crossJoin(F.broadcast(limit))
                     .where(F.col("_n") > F.col("_limit")).select(CODE, "_limit"))
    thinned = (rows.select(CODE, TIME).join(F.broadcast(long_machines), CODE)
               .where(F.pmod(F.xxhash64(CODE, TIME), F.col("_limit")) < marks))
    nth = F.dense_rank().over(Window.partitionBy(CODE).orderBy(TIME)) - 1
    cuts = (thinned.withColumn("_nth", nth)
            .where((F.col("_nth") > 0) & (F.col("_nth") % marks == 0))
            .groupBy(CODE).agg(F.array_sort(F.collect_set(TIME)).alias("_cuts")))
    # Two levels, so that finding a segment takes about 2 * sqrt(cuts) comparisons.
    width = F.ceil(F.sqrt(F.size("_cuts"))).cast("int")
    return (cuts.withColumn("_width", width)
            .withColumn("_groups", F.transform(
                F.sequence(F.lit(1), F.size("_cuts"), F.col("_width")),
                lambda at: F.slice("_cuts", at, F.col("_width"))))
            .withColumn("_heads", F.transform("_groups", lambda g: F.element_at(g, 1)))
            .select(CODE, F.size("_cuts").alias("_n_cuts"), "_width", "_groups", "_heads"))


def _segment_of(time: Column) -> Column:
    group = F.size(F.filter("_heads", lambda head: head <= time))
    inside = F.size(F.filter(F.get("_groups", group - 1), lambda cut: cut <= time))
    return F.when(group > 0, (group - 1) * F.col("_width") + inside).otherwise(F.lit(0))


def place(rows: DataFrame, cuts: DataFrame, long_only: bool = False) -> DataFrame:
    """Add the segment of each row and the last segment of its machine."""
    joined = rows.join(F.broadcast(cuts), CODE, "inner" if long_only else "left")
    return joined.select(
        *rows.columns,
        F.when(F.col("_n_cuts").isNull(), 0).otherwise(_segment_of(F.col(TIME)))
        .cast("int").alias(SEGMENT),
        F.coalesce("_n_cuts", F.lit(0)).cast("int").alias(LAST_SEGMENT))


def place_machines(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """Repeat each machine row once per segment, for joins on (machine, segment)."""
    joined = table.join(F.broadcast(cuts), CODE, "left")
    segments = F.sequence(F.lit(0), F.coalesce("_n_cuts", F.lit(0)).cast("int"))
    return joined.select(*table.columns, F.explode(segments).alias(SEGMENT))


def by_time(tie: Sequence[str] = ()) -> Window:
    return Window.partitionBy(CODE, SEGMENT).orderBy(TIME, *tie)


def running(tie: Sequence[str] = ()) -> Window:
    return by_time(tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole_segment() -> Window:
    return Window.partitionBy(CODE, SEGMENT)


def _borrowed_rows(long_rows: DataFrame, halo: int, link: str | None,
                   tie: Sequence[str]) -> DataFrame:
    """The last `halo` rows of each segment but the last, moved to the next segment."""
    columns = long_rows.columns
    order = by_time(tie)
    down = (F.coalesce(F.col(link), F.lit(0)) != 1) if link else F.lit(False)
    numbered = (long_rows.withColumn("_at", F.row_number().over(order))
                .withColumn("_size", F.count(F.lit(1)).over(whole_segment()))
                .withColumn("_down", F.max(F.when(down, F.col("_at"))).over(running(tie))))
    tails = numbered.where(F.col("_size") - F.col("_at") < halo)
    # From here on there are at most `halo` rows per segment.
    earlier = (Window.partitionBy(CODE).orderBy(SEGMENT)
               .rangeBetween(Window.unboundedPreceding, -1))
    closing = F.col("_at") == F.col("_size")
    tails = tails.withColumn(
        "_before", F.coalesce(F.sum(F.when(closing, F.col("_size"))).over(earlier), F.lit(0)))
    tails = tails.withColumn("_down_before", F.coalesce(F.max(
        F.when(closing, F.col("_before") + F.col("_down"))).over(earlier), F.lit(0)))
    row = F.col("_before") + F.col("_at")
    last_down = F.coalesce(F.col("_before") + F.col("_down"), F.col("_down_before"))
    return (tails.where(F.col(SEGMENT) < F.col(LAST_SEGMENT))
            .select(*[c for c in columns if c != SEGMENT],
                    (F.col(SEGMENT) + 1).cast("int").alias(SEGMENT),
                    F.lit(True).alias(BORROWED), row.alias(TRUE_ROW),
                    (row - last_down).alias(TRUE_RUN)))


def split_series(rows: DataFrame, halo: int, link: str | None = None, tie: Sequence[str] = (),
                 max_rows: int = MAX_ROWS, cuts: DataFrame | None = None) -> DataFrame:
    """Rows with their segment, plus the borrowed rows that precede each segment."""
    if cuts is None:
        cuts = cut_points(rows, halo, max_rows)
    own = (place(rows, cuts).withColumn(BORROWED, F.lit(False))
           .withColumn(TRUE_ROW, F.lit(None).cast("bigint"))
           .withColumn(TRUE_RUN, F.lit(None).cast("bigint")))
    return own.unionByName(_borrowed_rows(place(rows, cuts, long_only=True), halo, link, tie))


def attach_labels(series: DataFrame, labels: DataFrame, cuts: DataFrame) -> DataFrame:
    """Give each reading the `_fault` and `_rul` of the label with exactly its key, or null.

    Labels are as many as readings, so they travel in the same shuffle as the readings: both are
    stacked, and a label is found among the rows of equal time. They are dealt out by (machine,
    segment) here, which with their order is what the other windows need, so those add neither an
    exchange nor a sort. Rows of equal time are a group of their own and not a range frame, which
    would copy and compare every row.
    """
    markers = place(labels.select(CODE, TIME, F.col("fault_label").cast("int").alias(FAULT),
                                  F.col("rul_days").cast("double").alias(RUL)), cuts)
    stacked = series.withColumn("_marker", F.lit(False)).unionByName(
        markers.withColumn("_marker", F.lit(True)).withColumn(BORROWED, F.lit(False)),
        allowMissingColumns=True)
    same_time = Window.partitionBy(CODE, SEGMENT, TIME)
    return (stacked.repartition(CODE, SEGMENT).withColumns({c: F.max(c).over(same_time) for c in (FAULT, RUL)})
            .where(~F.col("_marker")).drop("_marker"))


def with_positions(series: DataFrame, link: str | None = None,
                   tie: Sequence[str] = ()) -> DataFrame:
    """Add `_row`, the position in the machine's whole history from 1, and for a `link` column
    `_run`, the number of consecutive rows up to this one in which it is 1."""
    at = F.col("_at")
    upto = running(tie)
    added = {ROW: at + F.coalesce(F.max(F.col(TRUE_ROW) - at).over(upto), F.lit(0))}
    if link:
        # The last row that was down; borrowed rows know how far back theirs lies.
        down = F.when(F.col(BORROWED), at - F.col(TRUE_RUN)).when(
            F.coalesce(F.col(link), F.lit(0)) != 1, at)
        added[RUN] = at - F.coalesce(F.max(down).over(upto), F.lit(0))
    return (series.withColumn("_at", F.row_number().over(by_time(tie)))
            .withColumns(added).drop("_at"))
