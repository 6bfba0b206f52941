"""Who wrote the line a finding is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines per bucket: a range covers few buckets, and few ranges share one.
BUCKET_LINES = 128


def _by_bucket(blame: DataFrame) -> DataFrame:
    """Each line range once per bucket of lines it touches."""

    def bucket(line: str) -> Column:
        return F.floor(F.col(line) / BUCKET_LINES)

    return blame.where(F.col("start_line") <= F.col("end_line")).withColumn(
        "_bucket", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))))


def with_blame(findings: DataFrame, blame: DataFrame) -> DataFrame:
    """Adds ``git_blame``, null where no range covers the line.

    Both sides meet on (repo, path, bucket of lines), so a file with very many
    findings is spread over its buckets and a finding is compared with the few
    ranges of its own bucket only.  Copies of a range count once; other ranges of
    a file must not overlap (``overlapping_ranges`` lists offenders).
    """
    author = F.struct(
        "author", "email", "commit", F.timestamp_seconds("author_time").alias("authored_at"))
    files = findings.select("repo", "path").distinct()
    blame = blame.join(files, ["repo", "path"], "left_semi")  # before ranges are cut up
    ranges = _by_bucket(blame).groupBy(
        "repo", "path", "_bucket", "start_line", "end_line"
    ).agg(F.min(author).alias("git_blame"))
    asked = findings.withColumn("_bucket", F.floor(F.col("line") / BUCKET_LINES)).alias("f")
    on = (
        (F.col("f.repo") == F.col("b.repo"))
        & (F.col("f.path") == F.col("b.path"))
        & (F.col("f._bucket") == F.col("b._bucket"))
        & F.col("f.line").between(F.col("b.start_line"), F.col("b.end_line"))
    )
    joined = asked.join(ranges.alias("b"), on, "left")
    return joined.select(*[F.col(f"f.{c}").alias(c) for c in findings.columns], "b.git_blame")


def overlapping_ranges(blame: DataFrame) -> DataFrame:
    """Ranges that begin before an earlier range of their file has ended, or are there twice.

    Ranges are cut at bucket borders; two ranges overlap exactly when their
    pieces do in some bucket, so no window spans a whole file.
    """
    low = F.col("_bucket") * BUCKET_LINES
    pieces = (
        _by_bucket(blame)
        .groupBy(*blame.columns, "_bucket")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_from", F.greatest(F.col("start_line"), low))
        .withColumn("_to", F.least(F.col("end_line"), low + BUCKET_LINES - 1))
    )
    before = (
        Window.partitionBy("repo", "path", "_bucket")
        .orderBy("_from", "start_line", "end_line", "commit")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        pieces.withColumn("_reached", F.max("_to").over(before))
        .where((F.col("_from") <= F.col("_reached")) | (F.col("_copies") > 1))
        .select(*blame.columns)
        .distinct()
    )
