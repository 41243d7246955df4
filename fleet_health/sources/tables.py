"""Reading and writing the tables of the data model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleet_health.schema import CONFIG_SCHEMA, HISTORY_SCHEMA


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             absent_as_null: bool = True) -> DataFrame:
    """A CSV table with a header row, matched to the schema by column name.

    A missing path is an empty table. Nothing is inferred. A schema column that the file lacks is
    null, or is left out with `absent_as_null=False`.
    """
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], schema)
        raise
    found = set(raw.columns)
    return raw.select(*[
        (F.col(f"`{f.name}`") if f.name in found else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields if absent_as_null or f.name in found])


BAD = "_bad_line"


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A foreign CSV file: its columns that the schema names, typed, and `_bad_line`.

    Columns are found by the file's own header, whatever their order; a header without a name is
    `_c` and its position. Lines that do not fit are kept whole in `_bad_line`, which is null for good
    ones. Nothing is inferred.
    """
    header = spark.read.option("header", True).csv(path).columns
    kinds = {f.name: f.dataType for f in schema.fields}
    own = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    raw = (spark.read.schema(own.add(BAD, T.StringType())).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", BAD).csv(path))
    # Only columns that are read are parsed: whether a line is bad must not depend on the query.
    parsed = F.hash(*[F.col(f"`{c}`") for c in header]) >= F.lit(-(2**31))
    return raw.select(*[f"`{c}`" for c in header if c in kinds], F.when(parsed, F.col(BAD)).alias(BAD))


# Fixed value: times in CSV files, with all their digits.
CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(table: DataFrame, path: str) -> None:
    (table.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", CSV_TIME).csv(path))


def write_table(table: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, our default format."""
    writer = table.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training history: a JSON array of objects, or one object per line."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).json(path, multiLine=True)
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], HISTORY_SCHEMA)
        raise


def write_history(history: DataFrame, path: str) -> None:
    """One object per epoch; epochs are few, so one file holding a JSON array."""
    rows = history.select(F.struct("*").alias("_row")).agg(
        F.to_json(F.array_sort(F.collect_list("_row"))).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def write_config(config: DataFrame, path: str) -> None:
    """A one-row configuration, with `rul_max`, as one JSON object beside the model."""
    config.coalesce(1).write.mode("overwrite").json(path)


def write_configs(configs: DataFrame, base: str) -> None:
    """Many configurations at once, one folder `model=<name>` each."""
    configs.withColumnRenamed("name", "model").write.mode("overwrite").partitionBy(
        "model").json(base)


def read_configs(spark: SparkSession, paths: str | list[str],
                 schema: T.StructType = CONFIG_SCHEMA) -> DataFrame:
    """Configurations from several folders; the model name is the folder name."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    table = spark.read.schema(schema).json(paths, multiLine=True)
    return table.select(F.regexp_replace(folder, "^model=", "").alias("name"), *table.columns)


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a metrics report as a text file."""
    report.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)
