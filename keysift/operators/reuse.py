"""Reuse of secrets over many scans, from sketches that are kept instead of the findings.

A run leaves one row for each secret: its findings, and sketches of the files and repositories it was
in.  Rows of any runs are merged without looking at a finding again; a file that several runs saw
counts once.  Sketches are HyperLogLog of ``LG_K`` bits: exact in effect up to some hundreds of files
and within about 2 % beyond, whatever the number of runs; a row is a few bytes for a rare secret and
4 KB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def _file() -> Column:
    """A place as one text; lengths keep two places apart that join to the same text."""
    repo, path = (F.coalesce(c, F.lit("")) for c in ("repo", "path"))
    return F.concat(F.length(repo).cast("string"), F.lit(":"), repo, F.lit("/"), path)


def run_sketches(findings: DataFrame, run: Column) -> DataFrame:
    """(run, secret_hash, n_findings, max_score, files, repos): what a run leaves of each secret.

    Sketches are made in every task before the shuffle, so a frequent secret sends one row for each
    task.  A null hash is a secret of its own.
    """
    return findings.groupBy(run.alias("run"), "secret_hash").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.max("score").alias("max_score"),
        F.hll_sketch_agg(_file(), LG_K).alias("files"),
        F.hll_sketch_agg(F.coalesce("repo", F.lit("")), LG_K).alias("repos"))


def reuse_over_runs(sketches: DataFrame) -> DataFrame:
    """Per secret: runs, findings of all runs, distinct files and repositories, first and last run."""
    return sketches.groupBy("secret_hash").agg(
        F.count_distinct("run").alias("n_runs"),
        F.sum("n_findings").alias("n_findings"),
        F.hll_sketch_estimate(F.hll_union_agg("files")).alias("n_files"),
        F.hll_sketch_estimate(F.hll_union_agg("repos")).alias("n_repos"),
        F.max("max_score").alias("max_score"),
        F.min("run").alias("first_run"),
        F.max("run").alias("last_run"))
