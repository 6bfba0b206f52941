"""Whether files changed between two looks at them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 256 bits of a file hash as hexadecimal slices that fit a bigint.
_SLICES = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))


def _content_hash() -> Column:
    """A file without content counts as empty."""
    return F.sha2(F.coalesce("content", F.lit("")), 256)


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", _content_hash().alias("content_hash"))


def _slice_sum(digest: Column, at: int, size: int) -> Column:
    return F.sum(F.conv(F.substring(digest, at, size), 16, 10).cast("decimal(20,0)"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, change): added, removed, changed or same.

    Only hashes are shuffled, and each task combines its rows per file first.  If a
    snapshot holds a path several times, its copies count as one file that is the
    same when their number and the sums of slices of their hashes are.
    """
    both = file_hashes(before).withColumn("side", F.lit(0)).unionByName(
        file_hashes(after).withColumn("side", F.lit(1)))

    def of(side: int) -> Column:
        return F.when(F.col("side") == side, F.col("content_hash"))

    per_file = both.groupBy("repo", "path").agg(
        F.min(of(0)).alias("hash_before"),
        F.min(of(1)).alias("hash_after"),
        (functools.reduce(operator.and_, (_slice_sum(of(0), at, n).eqNullSafe(_slice_sum(of(1), at, n))
                                          for at, n in _SLICES))
         & (F.count(of(0)) == F.count(of(1)))).alias("_rest"),
    )
    change = (
        F.when(F.col("hash_before").isNull(), "added")
        .when(F.col("hash_after").isNull(), "removed")
        .when((F.col("hash_before") == F.col("hash_after")) & F.col("_rest"), "same")
        .otherwise("changed")
    )
    return per_file.select("repo", "path", change.alias("change"), "hash_before", "hash_after")


def tree_digest(files: DataFrame) -> DataFrame:
    """One row (n_files, digest) for a whole tree.

    Every file gives SHA-256 of its repo, path and content hash; the digest is
    made of the sums of slices of these hashes.  Sums do not depend on order and
    add up per task, so no task holds the list of files.
    """
    identity = F.sha2(F.concat_ws("\n", "repo", "path", _content_hash()), 256)
    hashed = files.select(identity.alias("h"))

    sums = [F.coalesce(_slice_sum(F.col("h"), at, size), F.lit(0)).cast("string").alias(f"s{at}")
            for at, size in _SLICES]
    return hashed.agg(F.count(F.lit(1)).alias("n_files"), *sums).select(
        "n_files",
        F.sha2(F.concat_ws(":", F.col("n_files").cast("string"),
                           *[f"s{at}" for at, _ in _SLICES]), 256).alias("digest"),
    )


def is_unchanged(before: DataFrame, after: DataFrame) -> bool:
    return tree_digest(before).first() == tree_digest(after).first()
