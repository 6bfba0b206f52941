"""Counts over findings, files and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _level(name: str) -> Column:
    return F.count_if(F.col("risk_level") == name)


def total_findings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total_findings"))


def risk_summary(findings: DataFrame) -> DataFrame:
    """One row; levels without findings are there as 0."""
    return findings.agg(
        _level("high").alias("high_risk"),
        _level("medium").alias("medium_risk"),
        _level("low").alias("low_risk"),
        F.count(F.lit(1)).alias("total_findings"),
    )


def pattern_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_findings"))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n_findings"))


def files_per_repo(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"))


def ci_gate(findings: DataFrame) -> DataFrame:
    """One row: how many high-risk findings there are and whether the build fails."""
    return findings.agg(
        _level("high").alias("high_risk"), (_level("high") > 0).alias("failed"))


def gate_exit_code(findings: DataFrame) -> int:
    return 1 if ci_gate(findings).first()["failed"] else 0


def scan_stats(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, findings, findings per file."""
    file_count = files.agg(F.count(F.lit(1)).alias("files")).withColumn("findings", F.lit(0))
    found = findings.agg(F.count(F.lit(1)).alias("findings")).withColumn("files", F.lit(0))
    both = file_count.unionByName(found).agg(
        F.sum("files").alias("n_files"), F.sum("findings").alias("n_findings"))
    ratio = F.when(F.col("n_files") > 0, F.round(F.col("n_findings") / F.col("n_files"), 6))
    return both.withColumn("findings_per_file", ratio)


def scan_stats_of_run(files: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same of ``find(files)`` with one read: the files are counted while they are searched."""
    seen = Observation()
    found = find(files.observe(seen, F.count(F.lit(1)).alias("n_files")))
    n_findings = found.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n_files = seen.get["n_files"]
    ratio = round(n_findings / n_files, 6) if n_files else None
    return files.sparkSession.createDataFrame(
        [(n_files, n_findings, ratio)], "n_files LONG, n_findings LONG, findings_per_file DOUBLE")


def log_levels(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("n_records"))


def error_records(logs: DataFrame) -> DataFrame:
    return logs.where(F.upper("level") == "ERROR")


def observe_findings(findings: DataFrame) -> tuple[DataFrame, Observation]:
    """Counts taken while the findings are written, without a job of their own."""
    seen = Observation()
    counted = findings.observe(
        seen, F.count(F.lit(1)).alias("n_findings"), _level("high").alias("n_high_risk"))
    return counted, seen
