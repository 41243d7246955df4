"""Windows of a fixed number of readings, hopping by a stride, and the newest window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleet_health.operators import series as R
from fleet_health.operators.features import feature_series
from fleet_health.schema import CODE, STATIC_FEATURES, TIME, dynamic_features

LENGTH = 48
STRIDE = 12


def _index(parts: DataFrame, length: int, stride: int, tie: Sequence[str], *extra) -> DataFrame:
    """Rows that end a complete window, found with a lag instead of building the window."""
    first = F.col(R.ROW) - length
    return (R.with_positions(parts, None, tie)
            .withColumn("start_time", F.lag(TIME, length - 1).over(R.by_time(tie)))
            .where(~F.col(R.BORROWED) & (first >= 0) & (first % stride == 0))
            .select(CODE, (first / stride).cast("bigint").alias("window_no"), "start_time",
                    F.col(TIME).alias("target_time"), *extra))


def sequence_index(rows: DataFrame, length: int = LENGTH, stride: int = STRIDE,
                   tie: Sequence[str] = (), max_rows: int = R.MAX_ROWS) -> DataFrame:
    """Number, first and last time of every complete window of a machine."""
    keys = rows.where(F.col(CODE).isNotNull()).select(CODE, TIME, *tie)
    parts = R.split_series(keys, max(1, length - 1), None, tie, max_rows)
    return _index(parts, length, stride, tie)


def labelled_index(rows: DataFrame, static: DataFrame, labels: DataFrame, length: int = LENGTH,
                   stride: int = STRIDE, tie: Sequence[str] = (),
                   max_rows: int = R.MAX_ROWS) -> DataFrame:
    """Windows of registered machines whose last reading has a label."""
    keys = rows.where(F.col(CODE).isNotNull()).select(CODE, TIME, *tie)
    cuts = R.cut_points(keys, max(1, length - 1), max_rows)
    parts = R.split_series(keys, max(1, length - 1), None, tie, cuts=cuts)
    parts = R.attach_labels(parts, labels, cuts)
    registry = R.place_machines(static.select(CODE), cuts).hint("shuffle_hash")
    parts = parts.join(registry, [CODE, R.SEGMENT], "left_semi")
    return (_index(parts, length, stride, tie, R.FAULT, R.RUL)
            .where(F.col(R.FAULT).isNotNull())
            .withColumnsRenamed({R.FAULT: "fault_label", R.RUL: "rul_days"}))


#: The pane of the newest rows; others count from 0.
_NEWEST = -1


class Panes:
    """Stretches of consecutive rows of which every window is made, so that a row is read once.

    Each stride is cut where windows start and, at length % stride rows after that, where they end.
    So a window is a fixed number of consecutive panes, and a stride has two at most, whatever
    common divisors length and stride have. With gaps between windows (stride > length) a window is
    one pane, and the panes of the gaps are in none.

    With `newest`, the newest `length` rows of a machine that has as many are a further pane and a
    window of its own, marked by the column `newest`, with or without a label.
    """

    def __init__(self, length: int, stride: int, newest: bool = False):
        self.length, self.newest = length, newest
        strides, rest = divmod(length, stride)
        at = F.col(R.ROW) - 1
        whole = F.floor(at / stride)
        last = F.col("_pane")
        if rest:
            self.number = 2 * whole + F.when(at % stride < rest, 0).otherwise(1)
            self.size, self.ends = 2 * strides + 1, last % 2 == 0
            self.window_no = (last / 2).cast("bigint") - strides
        else:
            self.number, self.size, self.ends = whole, strides, F.lit(True)
            self.window_no = last - (strides - 1)
        apart = [last == _NEWEST] if newest else []
        order = Window.partitionBy(CODE, R.SEGMENT, *apart).orderBy("_pane")
        self.order, self.frame = order, order.rowsBetween(1 - self.size, 0)

    def of(self, parts: DataFrame, *facts) -> DataFrame:
        """One row per pane, aggregated in the (machine, segment) partitioning."""
        # Windows end where their last pane does, so it has the label and the time. Its columns one by
        # one, since with a struct among the buffers Spark sorts all readings again to aggregate them.
        number = self.number.cast("bigint")
        if self.newest:
            # They all lie in the last segment, borrowed rows included, as in `latest_parts`.
            parts = parts.withColumn("_last", F.max(R.ROW).over(R.whole_segment()))
            among = ((F.col(R.SEGMENT) == F.col(R.LAST_SEGMENT)) & (F.col("_last") >= self.length)
                     & (F.col(R.ROW) > F.col("_last") - self.length))
            number = F.explode(F.when(among, F.array(number, F.lit(_NEWEST).cast("bigint"))).otherwise(F.array(number)))
        return (parts.withColumn("_pane", number).groupBy(CODE, R.SEGMENT, "_pane").agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.max_by(c, R.ROW).alias(f"_end{c}") for c in (R.BORROWED, R.FAULT, R.RUL)],
            F.max(TIME).alias("target_time"), *facts))

    def windows(self, panes: DataFrame, combined: dict, made: list) -> DataFrame:
        """Whole labelled windows that end in their own segment.

        `combined` holds columns over the panes of a window, `made` what becomes of them. Panes of
        a segment follow each other without a gap, so `length` rows in `size` panes are a window.
        """
        joined = panes.withColumns({"_in_window": F.sum("_rows").over(self.frame), **combined})
        kept = (self.ends & (F.col("_in_window") == self.length) & ~F.col(f"_end{R.BORROWED}")
                & F.col(f"_end{R.FAULT}").isNotNull())
        number = self.window_no
        if self.newest:
            newest = F.col("_pane") == _NEWEST
            kept, number, made = newest | kept, F.when(~newest, number), [newest.alias("newest"), *made]
        return joined.where(kept).select(
            CODE, number.alias("window_no"), F.col(f"_end{R.FAULT}").alias("fault_label"),
            F.col(f"_end{R.RUL}").alias("rul_days"), "target_time", *made)


def _pane_facts(pool: str, name: str) -> list:
    """What a pane knows of a feature, to be combined over panes."""
    if pool in ("avg", "std"):
        kept = [F.sum(name).alias(f"_sum_{name}"), F.count(name).alias(f"_n_{name}")]
        return kept + ([F.var_pop(name).alias(f"_var_{name}")] if pool == "std" else [])
    if pool == "last":
        return [F.max_by(name, R.ROW).alias(f"_last_{name}")]
    return [getattr(F, pool)(name).alias(f"_{pool}_{name}")]


def _over_panes(pool: str, name: str, frame) -> tuple[dict, object]:
    """Columns over the panes of a window, and the pooled feature made of them."""
    if pool == "last":
        return {}, F.col(f"_last_{name}")
    if pool != "avg" and pool != "std":
        return {f"_w{pool}_{name}": getattr(F, pool)(f"_{pool}_{name}").over(frame)}, F.col(f"_w{pool}_{name}")
    total, n = f"_wsum_{name}", f"_wn_{name}"
    over = {total: F.sum(f"_sum_{name}").over(frame), n: F.sum(f"_n_{name}").over(frame)}
    mean = F.try_divide(F.col(total).cast("double"), F.col(n))
    if pool == "avg":
        return over, mean
    pieces = f"_wvar_{name}"
    over[pieces] = F.collect_list(F.struct(F.col(f"_n_{name}").alias("n"), F.col(f"_sum_{name}").alias("s"),
                                           F.col(f"_var_{name}").alias("v"))).over(frame)
    # Squares around the window's mean: inside each pane, and of the pane's own mean.
    squares = F.aggregate(F.filter(pieces, lambda p: p["n"] > 0), F.lit(0.0), lambda acc, p: acc + p["n"] * (
        p["v"] + F.pow(p["s"] / p["n"] - mean, 2)))
    return over, F.when(F.col(n) > 1, F.sqrt(squares / (F.col(n) - 1)))


_POOLS = {
    "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp,
    "last": lambda c: F.max_by(c, R.ROW),
}


def _pool_name(pool: str, name: str) -> str:
    return name if pool == "avg" else f"{name}_{pool}"


def _pooled(pools: Sequence[str], window_size: int) -> list:
    """Each telemetry feature per pool; registry features are the same in all rows of a group."""
    made = [_POOLS[p](name).alias(_pool_name(p, name))
            for p in pools for name in dynamic_features(window_size)]
    return [*made, *[F.max(name).alias(name) for name in STATIC_FEATURES]]


def _vector(window_size: int):
    """Telemetry and registry features of a row, as floats, in model order."""
    names = [*dynamic_features(window_size), *STATIC_FEATURES]
    return F.expr("array(" + ", ".join(f"cast({n} as float)" for n in names) + ")")


def pooled_sequences(rows: DataFrame, static_features: DataFrame, labels: DataFrame,
                     length: int = LENGTH, stride: int = STRIDE, window_size: int = 12,
                     tie: Sequence[str] = (), pools: Sequence[str] = ("avg",),
                     max_rows: int = R.MAX_ROWS, newest: bool = False, **stored) -> DataFrame:
    """One row per labelled window: pooled telemetry features and the registry features.

    Panes and windows form inside the (machine, segment) partitioning of the features, so neither
    needs a further shuffle, and no row is copied. With `newest`, the rows of `latest_pooled` come
    along from the same pass (`newest` is true, and their time is `target_time`); only the newest
    readings of a machine are copied for that.
    """
    parts = feature_series(rows, static_features, window_size, tie, length, labels,
                           carry=STATIC_FEATURES, max_rows=max_rows, **stored)
    panes = Panes(length, stride, newest)
    facts, combined, made = {}, {}, []
    for pool in pools:
        for name in dynamic_features(window_size):
            facts |= {str(f): f for f in _pane_facts(pool, name)}
            over, value = _over_panes(pool, name, panes.frame)
            combined |= over
            made.append(value.alias(_pool_name(pool, name)))
    of_rows = panes.of(parts, *facts.values(), *[F.max(name).alias(name) for name in STATIC_FEATURES])
    return panes.windows(of_rows, combined, [*made, *STATIC_FEATURES])


def array_sequences(rows: DataFrame, static_features: DataFrame, labels: DataFrame,
                    length: int = LENGTH, stride: int = STRIDE, window_size: int = 12,
                    tie: Sequence[str] = (), max_rows: int = R.MAX_ROWS, **stored) -> DataFrame:
    """One row per labelled window: `x`, length x (telemetry + registry features) as floats."""
    parts = feature_series(rows, static_features, window_size, tie, length, labels,
                           carry=STATIC_FEATURES, max_rows=max_rows, **stored)
    slim = parts.select(CODE, R.SEGMENT, TIME, R.BORROWED, R.FAULT, R.RUL, R.ROW,
                        _vector(window_size).alias("v"))
    panes = Panes(length, stride)
    steps = F.array_sort(F.collect_list(F.struct(R.ROW, "v")))["v"]
    of_rows = panes.of(slim, steps.alias("_steps"))
    # The arrays of a window's panes, oldest first, end to end.
    combined = {f"_x{i}": F.lag("_steps", i).over(panes.order) for i in range(1, panes.size)}
    x = F.concat(*[F.col(f"_x{i}") for i in range(panes.size - 1, 0, -1)], F.col("_steps"))
    return panes.windows(of_rows, combined, [x.alias("x")])


# --- newest readings --------------------------------------------------------------------------

def latest_reading(rows: DataFrame, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The newest row per machine, by partial aggregation."""
    newest = F.max_by(F.struct(TIME, *columns), F.struct(TIME, *tie))
    return rows.groupBy(CODE).agg(newest.alias("_r")).select(
        CODE, F.col(f"_r.{TIME}").alias(TIME), *[F.col(f"_r.{c}").alias(c) for c in columns])


def latest_rows(rows: DataFrame, length: int, tie: Sequence[str] = ()) -> DataFrame:
    """The newest `length` rows of machines that have as many, with `step` 0 for the oldest.

    The rank filter runs before the shuffle (each task keeps at most `length` rows per machine),
    so a long machine is cut down where it is read.
    """
    newest_first = Window.partitionBy(CODE).orderBy(F.desc(TIME), *[F.desc(t) for t in tie])
    ranked = (rows.withColumn("_rank", F.row_number().over(newest_first))
              .where(F.col("_rank") <= length))
    return (ranked.withColumn("_have", F.count(F.lit(1)).over(Window.partitionBy(CODE)))
            .where(F.col("_have") == length)
            .withColumn("step", F.lit(length) - F.col("_rank"))
            .drop("_rank", "_have"))


def latest_parts(parts: DataFrame, length: int, tie: Sequence[str] = ()) -> DataFrame:
    """The newest `length` rows per machine of a feature series, in its partitioning.

    They all lie in the last segment, borrowed rows included, if it was built for that many steps.
    """
    segment_rows = F.count(F.lit(1)).over(R.whole_segment())
    at = F.row_number().over(R.by_time(tie))
    return (parts.where(F.col(R.SEGMENT) == F.col(R.LAST_SEGMENT))
            .withColumn("_left", segment_rows - at)
            .where((F.col("_left") < length) & (F.col(R.ROW) + F.col("_left") >= length))
            .withColumn("step", (F.lit(length - 1) - F.col("_left")).cast("int"))
            .drop("_left"))


def latest_sequences(rows: DataFrame, static_features: DataFrame, length: int = LENGTH,
                     window_size: int = 12, tie: Sequence[str] = (),
                     max_rows: int = R.MAX_ROWS, **stored) -> DataFrame:
    """One row per registered machine with enough history: `x` of its newest window."""
    parts = feature_series(rows, static_features, window_size, tie, length,
                           carry=STATIC_FEATURES, max_rows=max_rows, **stored)
    step = F.struct(F.col("step"), _vector(window_size).alias("v"))
    groups = latest_parts(parts, length, tie).groupBy(CODE, R.SEGMENT).agg(
        F.max(TIME).alias(TIME), F.array_sort(F.collect_list(step)).alias("_steps"))
    return groups.select(CODE, TIME, F.col("_steps.v").alias("x"))


def latest_pooled(rows: DataFrame, static_features: DataFrame, length: int = LENGTH,
                  window_size: int = 12, tie: Sequence[str] = (),
                  pools: Sequence[str] = ("avg",), max_rows: int = R.MAX_ROWS,
                  **stored) -> DataFrame:
    """One row per registered machine with enough history: pooled features of its newest window."""
    parts = feature_series(rows, static_features, window_size, tie, length,
                           carry=STATIC_FEATURES, max_rows=max_rows, **stored)
    return latest_parts(parts, length, tie).groupBy(CODE, R.SEGMENT).agg(
        F.max(TIME).alias(TIME), *_pooled(pools, window_size)).drop(R.SEGMENT)
