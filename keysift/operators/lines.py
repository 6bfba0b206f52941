"""Text to numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_lines_sql(content: str) -> str:
    r"""SQL: lines end at \n, \r\n or \r.  Text without \r takes the plain-character split."""
    any_end = "concat(char(13), char(10), '|', char(13), '|', char(10))"
    return (f"CASE WHEN contains({content}, char(13)) THEN split({content}, {any_end}) "
            f"ELSE split({content}, char(10)) END")


def lines(files: DataFrame) -> DataFrame:
    """(repo, path, line, text), lines counted from 1."""
    # posexplode_outer equals posexplode here (a split is never empty) and spares
    # the size check that would split every text twice.
    return files.where(F.col("content").isNotNull()).select(
        "repo", "path", F.posexplode_outer(F.expr(split_lines_sql("content"))).alias("pos", "text")
    ).select("repo", "path", (F.col("pos") + 1).alias("line"), "text")
