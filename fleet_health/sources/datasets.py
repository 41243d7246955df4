"""Public sensor datasets in the common schema: each loader gives (static, dynamic, labels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleet_health.functions import scalars as S
from fleet_health.operators.features import encode_categories
from fleet_health.operators.ordering import exact_percentile
from fleet_health.schema import AI4I_SCHEMA, CODE, METRO_SCHEMA, TIME
from fleet_health.sources.tables import BAD, read_raw_csv

# Registry entries that the datasets do not have.
DEFAULTS = {"ASA_VERSION": "17.0.0.0", "DEFAULT_COLLATION": "1252LATIN1", "DB_PAGE_SIZE": 4096,
            "ODBC_FILE_SIZE_B": 100_000, "CLIENT_EXE_SIZE_B": 12_000_000,
            "HOME_TOTAL_MB": 5000.0, "HOME1_TOTAL_MB": 2000.0}
FAILURE_FLAGS = ["TWF", "HDF", "PWF", "OSF", "RNF"]
HOURS = 24
HOT_SHARE = 0.95


def _defaults(platform: str, version: str) -> list[Column]:
    values = {"PLATFORM": platform, "PLATFORM_VER": version, **DEFAULTS}
    return [(F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v)).alias(k)
            for k, v in values.items()]


def _ago(time: Column, days: int) -> Column:
    return time - F.make_dt_interval(F.lit(days))


# --- compressor sensors, one machine cut into weekly virtual machines ----------------------------

def week_code(time: Column) -> Column:
    """ISO year and week, e.g. 2025_W01 for 2024-12-30."""
    return F.format_string("%d_W%02d", F.extract(F.lit("YEAROFWEEK"), time), F.weekofyear(time))


def metro_static(raw: DataFrame) -> DataFrame:
    return (raw.groupBy(week_code(F.col("timestamp")).alias(CODE))
            .agg(F.min("timestamp").alias(TIME))
            .select(CODE, F.lit(1).alias("TERMINAL_TYPE_ID"), *_defaults("MetroPT3", "1.0"), TIME))


def metro_dynamic(raw: DataFrame) -> DataFrame:
    """Sensor readings mapped onto telemetry columns."""
    t = F.col("timestamp")

    def size(name: str, factor: int) -> Column:
        return F.round(F.abs(S.column_or(raw, name, 0.0)) * factor, 2)

    def whole(name: str, factor: int) -> Column:
        return S.truncate(F.abs(name) * factor)

    return raw.select(
        week_code(t).alias(CODE), t.alias(TIME),
        (S.column_or(raw, "index", 0) % 1_000_000).cast("bigint").cast("string")
        .alias("LAST_TKT_NUMBER"),
        t.alias("LAST_TXN_TIME"), t.alias("LAST_DOWNLOAD_TIME"), t.alias("LAST_UPLOAD_TIME"),
        (whole("TP2", 100) % 500).alias("TOTAL_TKT_ISSUED_YESTERDAY"),
        (whole("TP3", 100) % 300).alias("TOTAL_TKT_ISSUED_TODAY"),
        S.flag(S.column_or(raw, "COMP", 1.0) > 0.5).alias("NETWORK_LINK"),
        size("Oil_temperature", 10).alias("HOME_USED_MB"),
        size("Motor_current", 50).alias("HOME1_USED_MB"),
        size("Reservoirs", 10).alias("DB_FILE_SIZE_MB"),
        whole("TP2", 10_000).alias("DB_FILE_SIZE_IN_PAGES"),
        whole("TP3", 5_000).alias("DB_FREE_PAGES"),
        size("MPG", 5).alias("DB_MRR_LOG_DIR_SIZE_MB"),
        size("LPS", 2).alias("DB_CRASH_LOG_DIR_SIZE_MB"),
        _ago(t, 30).alias("OS_UP_SINCE"), _ago(t, 7).alias("DB_UP_SINCE"),
        _ago(t, 14).alias("CLIENT_LOG_EXIST_SINCE"), F.lit("Metro").alias("TC_MAKE"))


def metro_labels(raw: DataFrame) -> DataFrame:
    """The hottest twentieth of readings is faulty; hotter oil means less remaining life."""
    oil = F.col("Oil_temperature")
    span = raw.agg(F.min(oil).alias("_min"), F.max(oil).alias("_max"))
    facts = span.crossJoin(F.broadcast(exact_percentile(raw, "Oil_temperature", HOT_SHARE, "_hot")))
    hot = oil > F.col("_hot")
    left = F.lit(30.0) - F.try_divide(oil - F.col("_min"), F.col("_max") - F.col("_min")) * 30
    return raw.crossJoin(F.broadcast(facts)).select(
        week_code(F.col("timestamp")).alias(CODE), F.col("timestamp").alias(TIME),
        S.flag(hot).alias("fault_label"),
        F.when(hot, S.at_least_zero(left)).otherwise(F.lit(-1.0)).alias("rul_days"),
        F.when(hot, "overheat").otherwise("none").alias("failure_mode"))


# --- milling machines, one row each, expanded to hourly steps ------------------------------------

def _ai4i_codes(raw: DataFrame) -> DataFrame:
    return (raw.withColumnRenamed("UDI", CODE)
            .withColumn(CODE, F.format_string("TC%05d", F.col(CODE))))


def ai4i_static(raw: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    kinds = _ai4i_codes(raw).select(CODE, "Type").dropDuplicates()
    return (encode_categories(kinds, ["Type"], codes)
            .withColumn("TERMINAL_TYPE_ID", F.col("Type_enc") + 1).drop("Type", "Type_enc")
            .select(CODE, "TERMINAL_TYPE_ID", *_defaults("AI4I", "2020"),
                    F.lit("2020-01-01").cast("timestamp_ntz").alias(TIME)))


def _hourly(raw: DataFrame) -> DataFrame:
    start = F.lit("2020-06-01 06:00:00").cast("timestamp_ntz")
    steps = F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1)))
    return (_ai4i_codes(raw).withColumn("_step", steps).withColumn("_start", start)
            .withColumn(TIME, F.col("_start")
                        + F.make_dt_interval(F.lit(0), F.col("_step"))))


def ai4i_dynamic(raw: DataFrame) -> DataFrame:
    """Machine properties as hourly telemetry; disks of failing machines fill up at the end."""
    rows = _hourly(raw)
    torque, speed = F.col("Torque [Nm]"), F.col("Rotational speed [rpm]")
    late = F.greatest(F.col("_step") - 20, F.lit(0)) * S.flag(F.col("Machine failure") != 0)
    home = F.col("Air temperature [K]") + late * 5.0
    home1 = F.col("Process temperature [K]") + late * 3.0
    size, t, start = speed / 100, F.col(TIME), F.col("_start")
    return rows.select(
        CODE, TIME, (S.truncate(F.abs(home * 1000)) % 1_000_000).cast("string")
        .alias("LAST_TKT_NUMBER"),
        t.alias("LAST_TXN_TIME"), t.alias("LAST_DOWNLOAD_TIME"), t.alias("LAST_UPLOAD_TIME"),
        (F.abs(speed).cast("bigint") % 500).alias("TOTAL_TKT_ISSUED_YESTERDAY"),
        (S.truncate(F.abs(torque * 10)) % 300).alias("TOTAL_TKT_ISSUED_TODAY"),
        S.flag(F.abs(torque) < 60).alias("NETWORK_LINK"),
        F.round(home, 2).alias("HOME_USED_MB"), F.round(home1, 2).alias("HOME1_USED_MB"),
        F.round(size, 2).alias("DB_FILE_SIZE_MB"),
        S.truncate(size * 100).alias("DB_FILE_SIZE_IN_PAGES"),
        S.truncate(size * 60).alias("DB_FREE_PAGES"),
        F.round(torque, 2).alias("DB_MRR_LOG_DIR_SIZE_MB"),
        F.round(F.col("Tool wear [min]").cast("double"), 2).alias("DB_CRASH_LOG_DIR_SIZE_MB"),
        _ago(start, 30).alias("OS_UP_SINCE"), _ago(start, 7).alias("DB_UP_SINCE"),
        _ago(start, 14).alias("CLIENT_LOG_EXIST_SINCE"), F.lit("AI4I").alias("TC_MAKE"))


def ai4i_labels(raw: DataFrame) -> DataFrame:
    """Remaining life of failing machines runs from 15 to 0.5 days over the hourly steps.

    The step number is known from the expansion, so the ramp needs no window.
    """
    flags = [f for f in FAILURE_FLAGS if f in raw.columns]
    fail = F.col("Machine failure")
    ramp = F.lit(15.0) + F.col("_step") * F.lit((0.5 - 15.0) / (HOURS - 1))
    return _hourly(raw).select(
        CODE, TIME, fail.cast("int").alias("fault_label"),
        F.when(fail == 1, ramp).otherwise(F.lit(-1.0)).alias("rul_days"),
        S.first_set_flag(flags).alias("failure_mode"))


# --- dispatch ------------------------------------------------------------------------------------

def _metro_schema() -> T.StructType:
    """The file's first column is an index without a name, which Spark calls _c0."""
    return T.StructType([T.StructField("_c0" if f.name == "index" else f.name, f.dataType)
                         for f in METRO_SCHEMA.fields])


def _good(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_raw_csv(spark, path, schema).where(F.col(BAD).isNull()).drop(BAD)


def load_metro(spark: SparkSession, path: str):
    raw = _good(spark, path, _metro_schema()).withColumnRenamed("_c0", "index")
    return metro_static(raw), metro_dynamic(raw), metro_labels(raw)


def load_ai4i(spark: SparkSession, path: str):
    raw = _good(spark, path, AI4I_SCHEMA)
    return ai4i_static(raw), ai4i_dynamic(raw), ai4i_labels(raw)


def bad_lines(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The lines of a dataset's file that its loader leaves out, whole."""
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}, choose from {sorted(LOADERS)}")
    schema = _metro_schema() if name == "metropt3" else AI4I_SCHEMA
    return read_raw_csv(spark, path, schema).where(F.col(BAD).isNotNull()).select(BAD)


LOADERS = {"metropt3": load_metro, "ai4i2020": load_ai4i}


def load_dataset(spark: SparkSession, name: str, path: str):
    """(static, dynamic, labels) of a dataset by name."""
    if name not in LOADERS:
        raise ValueError(f"unknown dataset {name!r}, choose from {sorted(LOADERS)}")
    return LOADERS[name](spark, path)


def combine(tables: list[DataFrame]) -> DataFrame:
    """Stack tables of several datasets; columns that one lacks become null."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
