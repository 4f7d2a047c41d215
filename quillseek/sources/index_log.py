"""The index log as an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = "site string, location string, status string, message string"


def append_log(log: DataFrame, path: str) -> None:
    log.select("site", "location", "status", "message").write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)
