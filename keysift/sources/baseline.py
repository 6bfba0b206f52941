"""Findings of earlier scans, reduced to their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPORT = "findings ARRAY<STRUCT<secret_hash: STRING>>"
_FINDING = "secret_hash STRING"


def _hashes(df: DataFrame) -> DataFrame:
    return df.where(F.col("secret_hash").isNotNull()).select("secret_hash").distinct()


def baseline_from_report(spark: SparkSession, path: str) -> DataFrame:
    """Hashes in a JSON report that is one object in one file, however it is laid out."""
    report = spark.read.schema(_REPORT).json(path, multiLine=True)
    return _hashes(report.select(F.explode("findings").alias("f")).select("f.secret_hash"))


def baseline_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """Hashes in a report with one finding per line, read in parallel.

    Takes the parts of the JSON report of ``write_reports``, and files where a finding may follow
    a comma and some lines are no findings.
    """
    finding = F.from_json(F.ltrim("value", F.lit(",")), _FINDING)
    return _hashes(spark.read.text(path).select(finding.alias("f")).select("f.secret_hash"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Hashes in an earlier report, whichever of the two layouts it has.

    A report without findings is an empty baseline; a text in which no hash is found is an error.
    """
    for read in (baseline_from_lines, baseline_from_report):
        found = read(spark, path)
        if not found.isEmpty():
            return found
    if spark.read.text(path).where(F.trim("value") != "").isEmpty():
        return found
    report = spark.read.schema(_REPORT).json(path, multiLine=True)
    if not report.isEmpty() and report.where("coalesce(size(findings), -1) != 0").isEmpty():
        return found
    raise ValueError(f"no secret_hash in the baseline {path}")


def baseline_from_table(findings: DataFrame) -> DataFrame:
    return _hashes(findings)
