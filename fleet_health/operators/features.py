"""Registry and telemetry features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_health.functions import scalars as S
from fleet_health.operators import series as R
from fleet_health.operators.ordering import with_place
from fleet_health.schema import CODE, STATIC_FEATURES, TIME, dynamic_features

# Telemetry column -> prefix of its rolling features.
ROLLING_MEAN = {"HOME_USED_MB": "home_used", "DB_FREE_PAGES": "db_free",
                "DB_MRR_LOG_DIR_SIZE_MB": "mrr_log", "DB_CRASH_LOG_DIR_SIZE_MB": "crash_log"}
ROLLING_STD = {"HOME_USED_MB": "home_used", "DB_FREE_PAGES": "db_free"}


# --- categories -------------------------------------------------------------------------------

def category_dictionary(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, code): the 0-based place of each value among the sorted ones of its column.

    Store it at training time and pass it back when scoring, so that codes stay the same. There may
    be any number of values: they are sorted over ranges, and each range adds how many the column
    has in the ranges before it.
    """
    pairs = (table.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
                                             for c in columns])))
             .where(F.col("value").isNotNull()).distinct())
    return with_place(pairs, "name", [F.col("value")]).select(
        "name", "value", F.col("place").cast("int").alias("code"))


def encode_categories(table: DataFrame, columns: Sequence[str],
                      codes: DataFrame | None = None) -> DataFrame:
    """Add `<column>_enc`: 0-based place among the sorted values; null or unknown is -1.

    The codes are joined without a hint: Spark broadcasts them where they are small, and splits hot
    values of a shuffled join otherwise. Null values get keys that no code has, by a hash of their
    row, so that they do not meet in one task.
    """
    codes = category_dictionary(table, columns) if codes is None else codes
    row = F.xxhash64(*[c for c, kind in table.dtypes if "map<" not in kind]).cast("string")
    out = table
    for c in columns:
        own = codes.where(F.col("name") == c).select(
            F.concat(F.lit("="), "value").alias("_key"), F.col("code").alias("_code"))
        keyed = out.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), row))
        out = (keyed.join(own, "_key", "left")
               .withColumn(f"{c}_enc", F.coalesce("_code", F.lit(-1))).drop("_key", "_code"))
    return out


def registry_features(static: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    return encode_categories(static, ["PLATFORM", "ASA_VERSION"], codes)


# --- row-wise telemetry features --------------------------------------------------------------

def with_ticket_number(rows: DataFrame) -> DataFrame:
    return rows.withColumn("LAST_TKT_NUMBER_int", S.lenient_int("LAST_TKT_NUMBER"))


def with_cyclic_time(rows: DataFrame) -> DataFrame:
    hour_sin, hour_cos = S.hour_cycle(TIME)
    day_sin, day_cos = S.weekday_cycle(TIME)
    return rows.withColumns({"hour_sin": hour_sin, "hour_cos": hour_cos,
                             "day_of_week_sin": day_sin, "day_of_week_cos": day_cos})


def with_ratios(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "db_free_pct": S.guarded_ratio("DB_FREE_PAGES", "DB_FILE_SIZE_IN_PAGES", 100.0),
        "ticket_volume_ratio": S.guarded_ratio("TOTAL_TKT_ISSUED_TODAY",
                                               "TOTAL_TKT_ISSUED_YESTERDAY")})


def _capacity(static: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return static.select(CODE, F.col("HOME_TOTAL_MB").alias("_home_total"),
                         F.col("HOME1_TOTAL_MB").alias("_home1_total"),
                         F.lit(True).alias("_registered"), *extra)


def _usage(used: str, total: str) -> Column:
    """0 for a machine without registry row, null for a registered one with zero capacity."""
    return (F.when(F.col("_registered").isNull(), F.lit(0.0))
            .otherwise(S.percent_of(used, total)))


_USAGE = {"home_used_pct": ("HOME_USED_MB", "_home_total"),
          "home1_used_pct": ("HOME1_USED_MB", "_home1_total")}
_CAPACITY_COLUMNS = ("_home_total", "_home1_total", "_registered")


def with_disk_usage(rows: DataFrame, static: DataFrame) -> DataFrame:
    """Used share of the machine's disks.

    No broadcast hint: the registry grows with the fleet, so Spark broadcasts it only where its
    size is below the session's threshold, and splits hot machines of a shuffled join otherwise.
    """
    joined = rows.join(_capacity(static), CODE, "left")
    return (joined.withColumns({n: _usage(*cols) for n, cols in _USAGE.items()})
            .drop(*_CAPACITY_COLUMNS))


def latest_time(rows: DataFrame) -> DataFrame:
    """One row: the newest reading time of all machines, the reference point of the uptimes."""
    return rows.agg(F.max(TIME).alias("_now"))


_UPTIME = {"os_uptime_hours": "OS_UP_SINCE", "db_uptime_hours": "DB_UP_SINCE",
           "log_exist_hours": "CLIENT_LOG_EXIST_SINCE"}


def with_uptime(rows: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """Hours from each start time to `now` (a one-row table; by default the newest reading)."""
    joined = rows.crossJoin(F.broadcast(latest_time(rows) if now is None else now))
    return joined.withColumns({name: S.hours_between(since, "_now")
                               for name, since in _UPTIME.items()}).drop("_now")


# --- features over a machine's history --------------------------------------------------------

def with_rolling(parts: DataFrame, window_size: int, tie: Sequence[str] = ()) -> DataFrame:
    frame = R.by_time(tie).rowsBetween(-(window_size - 1), 0)
    added = {f"{prefix}_roll_mean_{window_size}": F.avg(name).over(frame)
             for name, prefix in ROLLING_MEAN.items()}
    added |= {f"{prefix}_roll_std_{window_size}":
              F.coalesce(F.stddev_samp(name).over(frame), F.lit(0.0))
              for name, prefix in ROLLING_STD.items()}
    return parts.withColumns(added)


def with_differences(parts: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    order = R.by_time(tie)
    return parts.withColumns({
        f"{prefix}_diff": F.coalesce(
            (F.col(name) - F.lag(name).over(order)).cast("double"), F.lit(0.0))
        for name, prefix in ROLLING_STD.items()})


def machine_moments(rows: DataFrame) -> DataFrame:
    """Mean and sample deviation per machine of the columns that get a z-score."""
    return rows.groupBy(CODE).agg(
        *[F.avg(c).alias(f"_mean_{p}") for c, p in ROLLING_STD.items()],
        *[F.stddev_samp(c).alias(f"_std_{p}") for c, p in ROLLING_STD.items()],
        F.lit(True).alias("_known"))


def _zscore(name: str, mean: Column, std: Column) -> Column:
    return (F.col(name) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def with_zscores(parts: DataFrame, rows: DataFrame, cuts: DataFrame,
                 stats: DataFrame | None = None) -> DataFrame:
    """Distance from the machine's own mean, in its own deviations, over its whole history.

    Machines in one segment take both from a window in the partitioning at hand. Long machines are
    few (bounded by the cut table), so theirs are aggregated first and broadcast. With `stats`
    (stored `machine_moments`) all values come from there, by a join in the same partitioning.
    """
    if stats is None:
        known = F.broadcast(machine_moments(R.place(rows, cuts, long_only=True)))
        joined = parts.join(known, CODE, "left")
    else:
        known = R.place_machines(stats, cuts)
        joined = parts.join(known.hint("shuffle_hash"), [CODE, R.SEGMENT], "left")
    whole = R.whole_segment()
    added = {}
    for name, prefix in ROLLING_STD.items():
        mean, std = F.col(f"_mean_{prefix}"), F.col(f"_std_{prefix}")
        if stats is None:
            mean = F.when(F.col("_known"), mean).otherwise(F.avg(name).over(whole))
            std = F.when(F.col("_known"), std).otherwise(F.stddev_samp(name).over(whole))
        added[f"{prefix}_zscore"] = _zscore(name, mean, std)
    return joined.withColumns(added).drop(*[c for c in known.columns if c not in (CODE, R.SEGMENT)])


def feature_series(rows: DataFrame, static: DataFrame, window_size: int = 12,
                   tie: Sequence[str] = (), steps: int = 1, labels: DataFrame | None = None,
                   now: DataFrame | None = None, stats: DataFrame | None = None,
                   carry: Sequence[str] = (), max_rows: int = R.MAX_ROWS) -> DataFrame:
    """All telemetry features, still in segments, with what windows of `steps` rows need.

    One shuffle of the readings, by (machine, segment), serves the registry join, the label match
    and every window. Row-wise features are computed after it, so only raw columns travel.
    Borrowed rows are in the result; the newest `steps` - 1 of them have exact features too.
    With `carry`, registry columns are added and readings of unregistered machines leave.
    """
    halo = max(1, window_size - 1 + steps - 1)
    now = latest_time(rows) if now is None else now
    if carry:
        rows = rows.where(F.col(CODE).isNotNull())
    cuts = R.cut_points(rows, halo, max_rows)
    parts = R.split_series(rows, halo, "NETWORK_LINK", tie, cuts=cuts)
    if labels is not None:
        parts = R.attach_labels(parts, labels, cuts)
    # Co-located with the windows below; a hash join, since a merge join would sort the rows twice.
    registry = R.place_machines(_capacity(static, carry), cuts).hint("shuffle_hash")
    parts = parts.join(registry, [CODE, R.SEGMENT], "inner" if carry else "left")
    parts = with_rolling(parts, window_size, tie)
    parts = with_differences(parts, tie)
    parts = R.with_positions(parts, "NETWORK_LINK", tie)
    parts = parts.withColumnRenamed(R.RUN, "netlink_stable_hours")
    parts = with_zscores(parts, rows, cuts, stats)
    parts = parts.withColumns({n: _usage(*cols) for n, cols in _USAGE.items()})
    parts = parts.drop(*_CAPACITY_COLUMNS)
    parts = with_ratios(with_cyclic_time(with_ticket_number(parts)))
    return with_uptime(parts, now)


_HELPERS = (R.SEGMENT, R.LAST_SEGMENT, R.BORROWED, R.TRUE_ROW, R.TRUE_RUN, R.ROW, R.FAULT,
            R.RUL)


def own_rows(parts: DataFrame) -> DataFrame:
    """Drop the borrowed rows and the helper columns."""
    return parts.where(~F.col(R.BORROWED)).drop(*_HELPERS)


def telemetry_features(rows: DataFrame, static: DataFrame, window_size: int = 12,
                       tie: Sequence[str] = (), now: DataFrame | None = None,
                       stats: DataFrame | None = None, labels: DataFrame | None = None,
                       max_rows: int = R.MAX_ROWS) -> DataFrame:
    """The readings with all derived feature columns, in machine and time order per partition.

    With `labels`, `fault_label` and `rul_days` of the same key are added, or null.
    """
    parts = feature_series(rows, static, window_size, tie, now=now, stats=stats, labels=labels,
                           max_rows=max_rows)
    if labels is not None:
        parts = parts.withColumnsRenamed({R.FAULT: "fault_label", R.RUL: "rul_days"})
    return own_rows(parts)


def feature_vector(features: DataFrame, window_size: int = 12, ordered: bool = False) -> DataFrame:
    """Keys and features only, in model order; `ordered` sorts inside the partitions, which is of
    use only after steps that changed the order."""
    picked = features.select(CODE, TIME, *dynamic_features(window_size))
    return picked.sortWithinPartitions(CODE, TIME) if ordered else picked


def registry_vector(static_features: DataFrame) -> DataFrame:
    return static_features.select(CODE, *STATIC_FEATURES)


# --- single feature groups --------------------------------------------------------------------

def rolling_features(rows: DataFrame, window_size: int = 12, tie: Sequence[str] = (),
                     max_rows: int = R.MAX_ROWS) -> DataFrame:
    parts = R.split_series(rows, max(1, window_size - 1), None, tie, max_rows)
    return own_rows(with_rolling(parts, window_size, tie))


def difference_features(rows: DataFrame, tie: Sequence[str] = (),
                        max_rows: int = R.MAX_ROWS) -> DataFrame:
    return own_rows(with_differences(R.split_series(rows, 1, None, tie, max_rows), tie))


def link_stability(rows: DataFrame, tie: Sequence[str] = (),
                   max_rows: int = R.MAX_ROWS) -> DataFrame:
    """Add `netlink_stable_hours`: despite its name, a number of readings in a row."""
    parts = R.split_series(rows, 1, "NETWORK_LINK", tie, max_rows)
    return own_rows(R.with_positions(parts, "NETWORK_LINK", tie)
                    .withColumnRenamed(R.RUN, "netlink_stable_hours"))


def zscore_features(rows: DataFrame, stats: DataFrame | None = None,
                    max_rows: int = R.MAX_ROWS) -> DataFrame:
    cuts = R.cut_points(rows, 1, max_rows)
    return with_zscores(R.place(rows, cuts), rows, cuts, stats).drop(*_HELPERS)
