"""Crash-log sources: one text file per log, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "crash_id bigint, name string, content string"


def _shape(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select(F.xxhash64(path).alias("crash_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return _shape(spark.read.text(path, wholetext=True))


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return _shape(spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(path))
