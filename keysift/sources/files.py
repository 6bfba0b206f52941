"""Files as tables: repository snapshots, the filters on them, repository roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions import paths
from keysift.options import ScanOptions
from keysift.session import join_keys, key_filter


def from_table(df: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    """A table of documents as files."""
    return df.select(
        repo.alias("repo"), path.alias("path"),
        F.octet_length(content).cast("bigint").alias("size"), content.alias("content"),
    )


def within_limits(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Depth, size and skip rules on a files table."""
    kept = files.where(F.col("size") <= options.max_file_size_mb * 1024 * 1024)
    if options.max_depth is not None:
        kept = kept.where(paths.depth(F.col("path")) <= options.max_depth)
    return kept.where(~paths.is_skipped(F.col("path"), options.skip_fragments))


def active_only(files: DataFrame, repos: DataFrame, **join_options: object) -> DataFrame:
    """Files of repositories that are not archived; an unknown flag counts as not archived."""
    active = repos.where(~F.coalesce(F.col("archived"), F.lit(False)))
    return key_filter(files, active, "repo", "left_semi", spread_by=["path"], **join_options)


def repo_roots(listing: DataFrame) -> DataFrame:
    """Directories that hold a ``.git`` directory."""
    marked = F.concat(F.lit("/"), F.col("path"))
    root = F.regexp_extract(marked, r"^(.*?)/\.git/", 1)
    return listing.where(marked.contains("/.git/")).select(
        F.ltrim(root, F.lit("/")).alias("root")).distinct()


def label_repos(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the innermost repository root above it, null when there is none.

    A file offers its parent directories (as many as it is deep) to an equality
    join with the roots.  Directories that are no root are dropped there, and the
    longest match per file is an aggregate, so no row meets every root.
    """
    parts = F.split("path", "/")
    parents = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    offered = listing.select("path", F.explode(parents).alias("root"))
    found = key_filter(offered, roots, "root", "left_semi", spread_by=["path"])
    innermost = found.groupBy("path").agg(F.max_by("root", F.length("root")).alias("repo_root"))
    return listing.join(innermost, "path", "left")


def label_findings(findings: DataFrame, roots: DataFrame) -> DataFrame:
    """Findings of a tree with the innermost repository root as ``repo``, where there is one.

    Findings are labelled and not files, so no text is moved.
    """
    labels = label_repos(findings.select("path").distinct(), roots).where(
        F.coalesce("repo_root", F.lit("")) != "")
    labelled = join_keys(findings, labels, "path", "left", ["line", "pattern", "occurrence"])
    return labelled.withColumn("repo", F.coalesce("repo_root", "repo")).select(*findings.columns)
