"""Small fleets for the tests, and brute-force answers in plain pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd

from fleet_health.schema import DYNAMIC_SCHEMA, STATIC_SCHEMA

START = pd.Timestamp("2024-01-01")


def readings(sizes: dict[str, int], seed: int = 0) -> pd.DataFrame:
    """Telemetry with irregular times; the link is sometimes down and sometimes null."""
    rng = np.random.default_rng(seed)
    frames = []
    for code, n in sizes.items():
        minutes = np.sort(rng.choice(200_000, n, replace=False))
        times = START + pd.to_timedelta(minutes, unit="min")
        link = pd.array(rng.choice([1, 1, 1, 1, 1, 1, 1, 0], n), dtype="Int64")
        link[rng.random(n) < 0.02] = pd.NA
        pages = rng.integers(0, 5000, n)
        frames.append(pd.DataFrame({
            "TERMINAL_CODE": code, "EXECUTION_TIME": times,
            "LAST_TKT_NUMBER": [str(v) for v in rng.integers(0, 10**6, n)],
            "TOTAL_TKT_ISSUED_YESTERDAY": rng.integers(0, 5, n),
            "TOTAL_TKT_ISSUED_TODAY": rng.integers(0, 5, n), "NETWORK_LINK": link,
            "HOME_USED_MB": rng.random(n) * 100, "HOME1_USED_MB": rng.random(n) * 50,
            "DB_FILE_SIZE_MB": rng.random(n), "DB_FILE_SIZE_IN_PAGES": pages,
            "DB_FREE_PAGES": rng.integers(0, 3000, n),
            "DB_MRR_LOG_DIR_SIZE_MB": rng.random(n), "DB_CRASH_LOG_DIR_SIZE_MB": rng.random(n),
            "OS_UP_SINCE": times - pd.Timedelta(days=3), "DB_UP_SINCE": times,
            "CLIENT_LOG_EXIST_SINCE": times - pd.Timedelta(hours=5)}))
    return pd.concat(frames, ignore_index=True).sample(frac=1, random_state=seed)


def registry(codes) -> pd.DataFrame:
    codes = list(codes)
    return pd.DataFrame({
        "TERMINAL_CODE": codes, "TERMINAL_TYPE_ID": 1,
        "PLATFORM": [["b", "a"][i % 2] for i in range(len(codes))], "ASA_VERSION": "v",
        "ODBC_FILE_SIZE_B": 10, "DB_PAGE_SIZE": 4096, "CLIENT_EXE_SIZE_B": 20,
        "HOME_TOTAL_MB": [500.0 + i for i in range(len(codes))], "HOME1_TOTAL_MB": 300.0,
        "EXECUTION_TIME": START})


def to_spark(spark, pdf: pd.DataFrame, schema):
    fields = {f.name: f for f in schema.fields}
    picked = [fields[c] for c in pdf.columns]
    rows = [tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp)
                  else v.item() if isinstance(v, np.generic) else v for v in row)
            for row in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, type(schema)(picked))


def dynamic(spark, pdf):
    return to_spark(spark, pdf, DYNAMIC_SCHEMA)


def static(spark, pdf):
    return to_spark(spark, pdf, STATIC_SCHEMA)


def expected_features(pdf: pd.DataFrame, static_pdf: pd.DataFrame, window: int = 12):
    """History features of each machine, one machine at a time."""
    out = []
    now = pdf["EXECUTION_TIME"].max()
    capacity = static_pdf.set_index("TERMINAL_CODE")["HOME_TOTAL_MB"]
    for code, g in pdf.groupby("TERMINAL_CODE"):
        g = g.sort_values("EXECUTION_TIME").reset_index(drop=True)
        for c, p in [("HOME_USED_MB", "home_used"), ("DB_FREE_PAGES", "db_free"),
                     ("DB_MRR_LOG_DIR_SIZE_MB", "mrr_log"),
                     ("DB_CRASH_LOG_DIR_SIZE_MB", "crash_log")]:
            g[f"{p}_roll_mean_{window}"] = [g[c][max(0, i - window + 1):i + 1].mean()
                                            for i in range(len(g))]
            if p in ("home_used", "db_free"):
                g[f"{p}_roll_std_{window}"] = [
                    np.nan_to_num(g[c][max(0, i - window + 1):i + 1].std()) for i in range(len(g))]
                g[f"{p}_diff"] = g[c].diff().fillna(0)
                g[f"{p}_zscore"] = (g[c] - g[c].mean()) / g[c].std()
        run, runs = 0, []
        for v in g["NETWORK_LINK"]:
            run = 0 if pd.isna(v) or v != 1 else run + 1
            runs.append(run)
        g["netlink_stable_hours"] = runs
        g["home_used_pct"] = (g["HOME_USED_MB"] / capacity[code] * 100
                              if code in capacity.index else 0.0)
        g["os_uptime_hours"] = (now - g["OS_UP_SINCE"]).dt.total_seconds() / 3600
        out.append(g)
    return pd.concat(out, ignore_index=True)
