"""Log records of the scanner, as JSON objects or as plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift import schemas

_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[([A-Z]+)\] (.*)$"


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOGS).json(path)


def parse_json_logs(lines: DataFrame) -> DataFrame:
    """A table with a ``value`` column of JSON objects as log records."""
    return lines.select(F.from_json("value", schemas.LOGS).alias("r")).select("r.*")


def read_text_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_text_logs(spark.read.text(path))


def parse_text_logs(lines: DataFrame) -> DataFrame:
    """Lines ``2025-01-31 08:00:00 [INFO] text``; other lines (progress bars) are no records."""
    value = F.col("value")
    return lines.where(value.rlike(_LINE)).select(
        F.to_timestamp(F.regexp_extract(value, _LINE, 1), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.regexp_extract(value, _LINE, 2).alias("level"),
        F.regexp_extract(value, _LINE, 3).alias("message"),
    )
