"""Fault and remaining-life labels, and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.functions import scalars as S
from fleet_health.schema import CODE, TIME


def registered_rows(rows: DataFrame, static: DataFrame) -> DataFrame:
    return rows.join(static.select(CODE), CODE, "left_semi")


def unregistered_machines(rows: DataFrame, static: DataFrame) -> DataFrame:
    """Machines that report but are not in the registry."""
    return rows.select(CODE).distinct().join(static.select(CODE), CODE, "left_anti")


def _machines(static: DataFrame, degradation: DataFrame) -> DataFrame:
    """Registered machines with their degradation, or nulls.

    Stacked and grouped instead of joined: Spark then knows that the result is no larger than both
    tables together, and broadcasts it in the next join if that is below the session's threshold.
    """
    columns = ["failure_mode", "days_to_failure", "start_of_degradation"]
    stacked = static.select(CODE, F.lit(True).alias("_registered")).unionByName(
        degradation.select(CODE, *columns), allowMissingColumns=True)
    return (stacked.groupBy(CODE).agg(F.max("_registered").alias("_registered"),
                                      *[F.max(c).alias(c) for c in columns])
            .where("_registered").drop("_registered"))


def labels_from_degradation(rows: DataFrame, static: DataFrame,
                            degradation: DataFrame) -> DataFrame:
    """Label every reading of a registered machine.

    From the start of degradation on, a reading is faulty and its remaining life runs down to 0;
    before it, the label is 0 with no remaining life (-1). The failure mode is set on all readings
    of a degrading machine. The readings are joined once.
    """
    failure = F.col("start_of_degradation") + F.make_dt_interval(F.col("days_to_failure"))
    started = F.col(TIME) >= F.col("start_of_degradation")
    remaining = S.at_least_zero(S.days_between(TIME, failure))
    return rows.select(CODE, TIME).join(_machines(static, degradation), CODE).select(
        CODE, TIME, S.flag(started).alias("fault_label"),
        F.when(started, F.round(remaining, 4)).otherwise(F.lit(-1.0)).alias("rul_days"),
        F.coalesce("failure_mode", F.lit("none")).alias("failure_mode"))


def list_labels(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Labels in key order; `limit` is the page size of a listing."""
    ordered = labels.orderBy(CODE, TIME)
    return ordered if limit is None else ordered.limit(limit)


def failure_mode_counts(labels: DataFrame) -> DataFrame:
    return (labels.where((F.col("fault_label") == 1) & F.col("failure_mode").isNotNull())
            .groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n_faults"))
            .orderBy(F.desc("n_faults"), "failure_mode"))


def failure_mode_map(labels: DataFrame) -> DataFrame:
    """One row with the counts as a map (failure modes are few)."""
    return failure_mode_counts(labels).agg(
        F.map_from_entries(F.collect_list(F.struct("failure_mode", "n_faults"))).alias("modes"))


def fault_rate(labels: DataFrame) -> DataFrame:
    return labels.agg((F.avg("fault_label") * 100).alias("fault_rate"))


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    return (table.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def require_unique(table: DataFrame, key: list[str]) -> DataFrame:
    """Return the table, or raise if a key occurs twice (a join would multiply its rows)."""
    if duplicate_keys(table, key).limit(1).count():
        raise ValueError(f"duplicate keys in {key}")
    return table


def machine_subset(n: int, rows: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Keep the first `n` machine codes of `rows` in all tables; n <= 0 keeps everything."""
    if n <= 0:
        return [rows, *tables]
    codes = rows.select(CODE).distinct().orderBy(CODE).limit(n)
    return [t.join(codes, CODE, "left_semi") for t in (rows, *tables)]
