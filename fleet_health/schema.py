"""Column names, table schemas and feature lists of the common data model."""

from __future__ import annotations

from pyspark.sql import types as T

CODE = "TERMINAL_CODE"
TIME = "EXECUTION_TIME"

# Order of the registry features in the model input.
STATIC_FEATURES = [
    "TERMINAL_TYPE_ID", "ODBC_FILE_SIZE_B", "DB_PAGE_SIZE", "CLIENT_EXE_SIZE_B",
    "HOME_TOTAL_MB", "HOME1_TOTAL_MB", "PLATFORM_enc", "ASA_VERSION_enc",
]


def dynamic_features(window_size: int = 12) -> list[str]:
    """Order of the telemetry features in the model input, for one rolling window size."""
    # Fixed values.
    return [
        "LAST_TKT_NUMBER_int", "TOTAL_TKT_ISSUED_YESTERDAY", "TOTAL_TKT_ISSUED_TODAY",
        "NETWORK_LINK", "HOME_USED_MB", "HOME1_USED_MB", "DB_FILE_SIZE_MB",
        "DB_FILE_SIZE_IN_PAGES", "DB_FREE_PAGES", "DB_MRR_LOG_DIR_SIZE_MB",
        "DB_CRASH_LOG_DIR_SIZE_MB", "hour_sin", "hour_cos", "day_of_week_sin",
        "day_of_week_cos", "home_used_pct", "home1_used_pct", "db_free_pct",
        "os_uptime_hours", "db_uptime_hours", "log_exist_hours", "ticket_volume_ratio",
        f"home_used_roll_mean_{window_size}", f"home_used_roll_std_{window_size}",
        f"db_free_roll_mean_{window_size}", f"db_free_roll_std_{window_size}",
        f"mrr_log_roll_mean_{window_size}", f"crash_log_roll_mean_{window_size}",
        "home_used_diff", "db_free_diff", "netlink_stable_hours", "home_used_zscore",
        "db_free_zscore",
    ]


DYNAMIC_FEATURES = dynamic_features()


def feature_dim(window_size: int = 12) -> int:
    return len(dynamic_features(window_size)) + len(STATIC_FEATURES)


def _struct(columns: str) -> T.StructType:
    """A schema from `name type, ...`; no session is needed."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
             "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "boolean": T.BooleanType()}
    pairs = [column.strip().rsplit(" ", 1) for column in columns.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


# Columns of the tables and files, in their order.
STATIC_SCHEMA = _struct(
    "TERMINAL_CODE string, TERMINAL_TYPE_ID int, PLATFORM string, PLATFORM_VER string, "
    "IP_ADDRESS_OS string, MAC_ADDRESS_OS string, ODBC_FILE_SIZE_B bigint, "
    "DB_FILE_PATH_NAME string, DB_LOG_FILE_PATH_NAME string, ASA_VERSION string, "
    "DEFAULT_COLLATION string, DB_PAGE_SIZE bigint, CLIENT_EXE_SIZE_B bigint, "
    "HOME_TOTAL_MB double, HOME1_TOTAL_MB double, EXECUTION_TIME timestamp_ntz")

DYNAMIC_SCHEMA = _struct(
    "TERMINAL_CODE string, EXECUTION_TIME timestamp_ntz, LAST_TKT_NUMBER string, "
    "LAST_TXN_TIME timestamp_ntz, LAST_DOWNLOAD_TIME timestamp_ntz, "
    "LAST_UPLOAD_TIME timestamp_ntz, TOTAL_TKT_ISSUED_YESTERDAY bigint, "
    "TOTAL_TKT_ISSUED_TODAY bigint, NETWORK_LINK int, HOME_USED_MB double, HOME1_USED_MB double, "
    "DB_FILE_SIZE_MB double, DB_FILE_SIZE_IN_PAGES bigint, DB_FREE_PAGES bigint, "
    "DB_MRR_LOG_DIR_SIZE_MB double, DB_CRASH_LOG_DIR_SIZE_MB double, OS_UP_SINCE timestamp_ntz, "
    "DB_UP_SINCE timestamp_ntz, CLIENT_LOG_EXIST_SINCE timestamp_ntz, "
    "DB_PURGING_UPTO timestamp_ntz, TC_MAKE string")

DEGRADATION_SCHEMA = _struct(
    "TERMINAL_CODE string, failure_mode string, days_to_failure int, "
    "start_of_degradation timestamp_ntz")

LABELS_SCHEMA = _struct(
    "TERMINAL_CODE string, EXECUTION_TIME timestamp_ntz, fault_label int, rul_days double, "
    "failure_mode string")

PREDICTIONS_SCHEMA = _struct(
    "TERMINAL_CODE string, EXECUTION_TIME timestamp_ntz, fault_probability double, "
    "predicted_rul_days double, is_fault_risk boolean")

HISTORY_SCHEMA = _struct(
    "epoch int, train_loss double, train_fault_loss double, train_rul_loss double, "
    "val_fault_accuracy double, val_fault_precision double, val_fault_recall double, "
    "val_fault_f1 double, val_rul_mae double, val_rul_rmse double")

CONFIG_SCHEMA = _struct(
    "num_machines bigint, days int, samples_per_machine bigint, seq_len int, stride int, "
    "input_dim int, epochs int, failure_rate double, rul_max double")

METRO_SCHEMA = _struct(
    "index bigint, timestamp timestamp_ntz, TP2 double, TP3 double, H1 double, "
    "DV_pressure double, Reservoirs double, Oil_temperature double, Motor_current double, "
    "COMP double, DV_eletric double, Towers double, MPG double, LPS double, "
    "Pressure_switch double, Oil_level double, Caudal_impulses double")

AI4I_SCHEMA = _struct(
    "UDI int, Product ID string, Type string, Air temperature [K] double, "
    "Process temperature [K] double, Rotational speed [rpm] int, Torque [Nm] double, "
    "Tool wear [min] int, Machine failure int, TWF int, HDF int, PWF int, OSF int, RNF int")
