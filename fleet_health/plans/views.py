"""The star-schema tables seen as a machine fleet. Each view is a plain projection or join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleet_health.functions import scalars as S
from fleet_health.operators.labels import labels_from_degradation
from fleet_health.operators.scoring import linear_scores
from fleet_health.schema import CODE, TIME

# Names of the failure modes.
FAILURE_MODES = ["disk_exhaustion", "db_full", "db_corruption", "memory_leak", "log_growth",
                 "network_degradation"]


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is taken from the files once, since that costs a job each time."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _code(key: str):
    """TC and six digits; keys of up to six digits are padded, which takes less time than a format."""
    k = F.col(key)
    return F.when(k.between(0, 999_999), F.concat(F.lit("TC"), F.lpad(k.cast("string"), 6, "0"))).otherwise(
        F.format_string("TC%06d", k))


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _days(n):
    return F.make_dt_interval(n if not isinstance(n, int) else F.lit(n))


def static(spark, sf_dir) -> DataFrame:
    """Customers that have events, as the registry; some are left out on purpose."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    return (table(spark, sf_dir, "customer").where(k % 50 != 49)
            .join(users, k == F.col("user_id"), "left_semi")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(_code("c_custkey").alias(CODE),
                    (k % 3 + 1).cast("int").alias("TERMINAL_TYPE_ID"),
                    F.when(k % 40 != 39, F.col("c_mktsegment")).alias("PLATFORM"),
                    F.col("n_name").alias("PLATFORM_VER"), F.col("r_name").alias("ASA_VERSION"),
                    F.lit(4096).cast("bigint").alias("DB_PAGE_SIZE"),
                    (k * 10 + 50_000).alias("ODBC_FILE_SIZE_B"),
                    (k * 1000 + 8_000_000).alias("CLIENT_EXE_SIZE_B"),
                    (F.abs("c_acctbal") + 600).alias("HOME_TOTAL_MB"),
                    (F.abs("c_acctbal") / 2 + 300).alias("HOME1_TOTAL_MB"),
                    _ts("2024-01-01 00:00:00").alias(TIME)))


def dynamic(spark, sf_dir) -> DataFrame:
    """Events as telemetry."""
    e, v, ts = F.col("event_id"), F.col("value"), F.col("ts")
    return table(spark, sf_dir, "events").select(
        _code("user_id").alias(CODE), ts.alias(TIME), e.alias("event_id"),
        F.when(F.col("event_type") == "view", F.lit("n/a"))
        .otherwise(F.regexp_extract("props", r"([0-9]+)", 1)).alias("LAST_TKT_NUMBER"),
        ts.alias("LAST_TXN_TIME"), ts.alias("LAST_DOWNLOAD_TIME"), ts.alias("LAST_UPLOAD_TIME"),
        (e % 150).alias("TOTAL_TKT_ISSUED_YESTERDAY"), (e % 120).alias("TOTAL_TKT_ISSUED_TODAY"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("NETWORK_LINK"),
        v.alias("HOME_USED_MB"), (v / 2).alias("HOME1_USED_MB"), (v * 2).alias("DB_FILE_SIZE_MB"),
        (e % 5000).alias("DB_FILE_SIZE_IN_PAGES"), (e * 7 % 3000).alias("DB_FREE_PAGES"),
        (v / 10).alias("DB_MRR_LOG_DIR_SIZE_MB"), (v / 20).alias("DB_CRASH_LOG_DIR_SIZE_MB"),
        (ts - _days((e % 60).cast("int"))).alias("OS_UP_SINCE"),
        (ts - _days((e % 30).cast("int"))).alias("DB_UP_SINCE"),
        (ts - _days((e % 14).cast("int"))).alias("CLIENT_LOG_EXIST_SINCE"),
        F.col("event_type").alias("TC_MAKE"))


def lineitem_dynamic(spark, sf_dir) -> DataFrame:
    """Line items as a larger telemetry table with few machines (for measuring)."""
    q, n = F.col("l_quantity"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        _code("l_suppkey").alias(CODE), F.col("l_shipdate").alias(TIME),
        "l_orderkey", "l_linenumber", q.alias("HOME_USED_MB"),
        (n * 7 % 3000).alias("DB_FREE_PAGES"), (q / 10).alias("DB_MRR_LOG_DIR_SIZE_MB"),
        (q / 20).alias("DB_CRASH_LOG_DIR_SIZE_MB"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("NETWORK_LINK"))


def degradation(spark, sf_dir) -> DataFrame:
    k = F.substring(CODE, 3, 10).cast("bigint")
    days = (k % 20 + 5).cast("int")
    failed = _ts("2024-01-31 00:00:00") - _days((k % 5 + 1).cast("int"))
    mode = F.element_at(F.array(*[F.lit(m) for m in FAILURE_MODES]),
                        (F.floor(k / 7) % 6 + 1).cast("int"))
    return static(spark, sf_dir).where(k % 7 == 0).select(
        CODE, mode.alias("failure_mode"), days.alias("days_to_failure"),
        (failed - _days(days)).alias("start_of_degradation"))


def labels(spark, sf_dir) -> DataFrame:
    return labels_from_degradation(dynamic(spark, sf_dir), static(spark, sf_dir),
                                   degradation(spark, sf_dir))


def scored(spark, sf_dir) -> DataFrame:
    """Labelled readings with a probability and a predicted remaining life."""
    usage = dynamic(spark, sf_dir).select(CODE, TIME, "HOME_USED_MB")
    l1 = (F.col("HOME_USED_MB") - 50) / 25
    prob = F.round(S.softmax_positive(F.lit(0.0), l1), 4)
    return (labels(spark, sf_dir).join(usage, [CODE, TIME])
            .select(CODE, TIME, F.col("fault_label").alias("y_true"), prob.alias("prob"),
                    F.col("rul_days").alias("rul_true"), F.lit(0.0).alias("l0"), l1.alias("l1"))
            .withColumn("rul_pred", (F.lit(1.0) - F.col("prob")) * 30))


def predictions(spark, sf_dir, length: int = 24) -> DataFrame:
    return linear_scores(dynamic(spark, sf_dir), static(spark, sf_dir), length)


def metro(spark, sf_dir) -> DataFrame:
    """Events as one sensor series; the column MPG is missing on purpose."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"), F.col("ts").alias("timestamp"), (v / 10).alias("TP2"),
        (v / 20).alias("TP3"), (v / 50).alias("Reservoirs"),
        (v / 10 + 50).alias("Oil_temperature"), (v / 100).alias("Motor_current"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("COMP"),
        (v / 30).alias("LPS"))


def ai4i(spark, sf_dir) -> DataFrame:
    """Parts as single-row machines with failure flags."""
    p, size = F.col("p_partkey"), F.col("p_size")
    failed = p % 29 == 0
    which = F.floor(p / 29) % 6
    flags = [S.flag(failed & (which == i)).alias(name)
             for i, name in enumerate(["TWF", "HDF", "PWF", "OSF", "RNF"])]
    return table(spark, sf_dir, "part").select(
        (p + 1).cast("int").alias("UDI"),
        F.when(size % 3 == 0, "H").when(size % 3 == 1, "L").otherwise("M").alias("Type"),
        (size / 10 + 295).alias("Air temperature [K]"),
        (size / 10 + 305).alias("Process temperature [K]"),
        (p % 1500 + 1200).cast("int").alias("Rotational speed [rpm]"),
        (size + F.lit(20.0)).alias("Torque [Nm]"), (p % 250).cast("int").alias("Tool wear [min]"),
        S.flag(failed).alias("Machine failure"), *flags)


def batches(spark, sf_dir) -> DataFrame:
    """Events as per-batch losses of five epochs."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 5 + 1).cast("int").alias("epoch"),
        (F.col("value") / 100).alias("loss"), (F.col("value") / 200).alias("fault_loss"),
        (F.col("value") / 200).alias("rul_loss"))


def history(spark, sf_dir) -> DataFrame:
    """A training history computed from the events: errors are the faults, a large value an alarm.

    Epoch 1 raises no alarm (F1 of 0) and epoch 4 has no remaining-life error.
    """
    epoch = (F.col("event_id") % 5 + 1).cast("int")
    true = F.col("event_type") == "error"
    alarm = (F.col("value") > 50) & (F.col("epoch") > 1)
    hits, wrong = F.count_if(true & alarm), F.count_if(true != alarm)
    miss = F.avg(F.abs(F.col("value") - 50)) / 10
    return (table(spark, sf_dir, "events").withColumn("epoch", epoch).groupBy("epoch").agg(
        F.round(F.avg("value") / 100, 4).alias("train_loss"),
        F.round(F.lit(1.0) - wrong / F.count(F.lit(1)), 4).alias("val_fault_accuracy"),
        F.round(2 * hits / (2 * hits + wrong), 4).alias("val_fault_f1"),
        F.when(F.col("epoch") != 4, F.round(miss, 4)).alias("val_rul_mae")))


def model_configs(spark, sf_dir) -> DataFrame:
    """One model configuration per size class of parts."""
    kind = F.col("p_size") % 8
    return (table(spark, sf_dir, "part")
            .groupBy(F.when(kind == 0, "model_quick")
                     .otherwise(F.concat(F.lit("model_"), kind.cast("string"))).alias("name"))
            .agg(F.count(F.lit(1)).alias("num_machines"), F.min("p_size").alias("seq_len"),
                 F.max("p_retailprice").alias("rul_max")))


def model_files(spark, sf_dir, modulus: int) -> DataFrame:
    """Names of models for which a file exists (here: by the number in the name)."""
    number = F.coalesce(F.regexp_extract("name", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    return model_configs(spark, sf_dir).where(number % modulus == 0).select("name")
