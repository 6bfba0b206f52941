"""One finding per secret, and where else a secret occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report_order() -> list[Column]:
    """Highest score first, then by place.  Total over distinct findings."""
    return [F.desc("score"), F.asc("repo"), F.asc("path"), F.asc("line"), F.asc("pattern"),
            F.asc("occurrence")]


def deduplicate(findings: DataFrame) -> DataFrame:
    """The first finding of every secret in report order.

    ``row_number() = 1`` lets each task keep only its own first row per secret
    before the shuffle, so a secret found in a third of all files still sends at
    most one row per task.
    """
    first = Window.partitionBy("secret_hash").orderBy(*report_order())
    return findings.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def secret_reuse(findings: DataFrame, approximate: bool = False) -> DataFrame:
    """Per secret: findings, repositories, files, and the range of its places.

    Rows are first counted per secret and file, which spreads a frequent secret
    over many tasks; the second step sees one row per file.
    """
    per_file = findings.groupBy("secret_hash", "repo", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("score").alias("score"),
        F.min("line").alias("line"),
    )
    repos = F.approx_count_distinct("repo") if approximate else F.count_distinct("repo")
    return per_file.groupBy("secret_hash").agg(
        F.sum("n").alias("n_findings"),
        F.count(F.lit(1)).alias("n_files"),
        repos.alias("n_repos"),
        F.max("score").alias("max_score"),
        F.min("repo").alias("first_repo"),
        F.max("repo").alias("last_repo"),
        F.min("path").alias("first_path"),
        F.max("path").alias("last_path"),
    )


def sort_findings(findings: DataFrame) -> DataFrame:
    """Report order over all tasks.

    A distributed sort looks at its input twice, first to pick the ranges, so the
    input should be a stored table and not a scan (``session.materialize``).
    """
    return findings.orderBy(*report_order())
