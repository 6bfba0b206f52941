"""Line authorship from ``git blame --porcelain`` output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADER = r"^([0-9a-f]{40}) ([0-9]+) ([0-9]+)(?: ([0-9]+))?"
_AUTHOR = "struct<author: string, email: string, author_time: bigint>"


def _field(block: Column, name: str) -> Column:
    """The value of a metadata line, null when the block has none."""
    found = F.regexp_extract(block, f"\\n{name} ([^\\n]*)", 1)
    return F.when(found != "", found)


def _author(block: Column) -> Column:
    return F.struct(
        _field(block, "author"),
        F.translate(_field(block, "author-mail"), "<>", ""),
        _field(block, "author-time").try_cast("bigint"),
    ).cast(_AUTHOR)


def _commit(block: Column) -> Column:
    return F.regexp_extract(block, _HEADER, 1)


def parse_porcelain(outputs: DataFrame) -> DataFrame:
    """(repo, path, porcelain) to one row per run of lines from one commit.

    One row holds the blame of one file.  Its text is cut into blocks, one per source line, and each
    block is read by itself; a block that opens a run states the run's length.  Author lines
    come once per commit, in the first block of it, and reach the other runs of the commit
    through a window over (file, commit), so the work grows with the text.
    """
    blocks = F.split("porcelain", r"\n(?=[0-9a-f]{40} [0-9]+ [0-9]+)")
    block = F.col("block")
    length = F.regexp_extract(block, _HEADER, 4)
    runs = (
        outputs.select("repo", "path", F.explode(blocks).alias("block"))
        .where(length != "")
        .select("repo", "path", F.regexp_extract(block, _HEADER, 3).try_cast("int").alias("start_line"),
                length.try_cast("int").alias("length"), _commit(block).alias("commit"),
                F.when(_field(block, "author").isNotNull(), _author(block)).alias("told"))
    )
    of_commit = Window.partitionBy("repo", "path", "commit")
    return runs.withColumn("a", F.max("told").over(of_commit)).select(
        "repo", "path", "start_line", (F.col("start_line") + F.col("length") - 1).alias("end_line"),
        "a.author", "a.email", "commit", "a.author_time")
