"""Digests of directories, and the difference of two trees that follows them down.

A file's digest is the SHA-256 of its content; a directory's is the SHA-256 of the sorted lines of
its children, each its kind, digest and name.  So two directories with one digest hold the
same names with the same contents, at any depth.  Levels are rolled up one after the other, the
deepest first, each stored before the next.

The children of a wide directory are first folded in blocks by the beginning of the hash of their
names, so many digits long that a block holds about ``BLOCK`` of them; the directory then hashes
the sorted blocks.  The number of digits follows from the number of children alone, so it is part of
the digest's definition and no task holds all children of a directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.session import materialize

# Children of a block, about; a directory with more is folded in blocks.
BLOCK = 4096
ROOT = ""


def _parent(path: Column) -> Column:
    """The directory of a path; the root is empty."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(ROOT))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _depth(directory: Column) -> Column:
    """Directories between the root and this one; the root has 0."""
    return F.when(directory == ROOT, 0).otherwise(F.size(F.split(directory, "/")))


def _hash_of(lines: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


def _digits(children: Column) -> Column:
    """Hex digits that name a block, for so many children."""
    return F.ceil(F.log2(F.greatest(children / F.lit(float(BLOCK)), F.lit(1.0))) / 4).cast("int")


def _fold(entries: DataFrame) -> DataFrame:
    """(repo, dir, n_children, digest) of the directories of ``entries``."""
    counted = entries.groupBy("repo", "dir").agg(_digits(F.count(F.lit(1))).alias("digits"))
    # At most one row for each BLOCK entries.
    wide = materialize(counted.where("digits > 0"), "wide")
    digits = F.coalesce(F.col("digits"), F.lit(0))
    line = F.concat_ws(" ", "kind", "digest", "name")
    blocks = entries.join(wide, ["repo", "dir"], "left").groupBy(
        "repo", "dir", F.substring(F.sha2("name", 256), F.lit(1), digits).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), _hash_of(line).alias("digest"))
    inner = F.concat_ws(" ", "block", "digest")
    # A directory of one block has the hash of its children.
    return blocks.groupBy("repo", "dir").agg(
        F.sum("n").alias("n_children"),
        F.when(F.max("block") == "", F.max("digest")).otherwise(_hash_of(inner)).alias("digest"))


def tree_entries(files: DataFrame) -> DataFrame:
    """(repo, dir, name, kind, digest, depth): all files and directories below the directory that holds
    them, and each repository's root with a null dir.

    Empty parts of a path count as they stand, a file without content as an empty one; a path that is
    there twice is two children.  ``depth`` is that of the directory.
    """
    path = F.ltrim(F.col("path"), F.lit("/"))
    hashed = files.select(
        "repo", _parent(path).alias("dir"), _name(path).alias("name"), F.lit("file").alias("kind"),
        F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    level = materialize(hashed.withColumn("depth", _depth(F.col("dir"))), "files")
    deepest = level.agg(F.max("depth")).first()[0]
    stored, above = [level], None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = level.where(F.col("depth") == depth)
        if above is not None:
            here = here.unionByName(above)
        folded = _fold(here)
        inside = F.col("dir") != ROOT
        above = materialize(folded.select(
            "repo", F.when(inside, _parent(F.col("dir"))).alias("dir"),
            F.when(inside, _name(F.col("dir"))).otherwise("").alias("name"),
            F.lit("directory").alias("kind"), "digest", F.lit(depth - 1).alias("depth")), "level")
        stored.append(above)
    entries = stored[0]
    for more in stored[1:]:
        entries = entries.unionByName(more)
    return entries


def directory_digests(files: DataFrame) -> DataFrame:
    """(repo, dir, depth, digest) of every directory that holds a file; the root's dir is empty."""
    return _directories(tree_entries(files))


def _directories(entries: DataFrame) -> DataFrame:
    path = F.when(F.col("dir").isNull(), F.lit(ROOT)).when(F.col("dir") == ROOT, F.col("name")).otherwise(
        F.concat_ws("/", "dir", "name"))
    return entries.where("kind = 'directory'").select(
        "repo", path.alias("dir"), (F.col("depth") + 1).alias("depth"), "digest")


def entries_digest(entries: DataFrame) -> DataFrame:
    """(n_repos, digest) of all trees together."""
    roots = entries.where("dir IS NULL").select(
        F.lit(ROOT).alias("dir"), F.lit("all").alias("repo"), F.col("repo").alias("name"), "kind", "digest")
    return _fold(roots).select(F.col("n_children").alias("n_repos"), "digest")


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, kind, change) of what differs between two ``tree_entries``.

    From the roots on, only directories whose digests differ are opened, one level a round: an
    unchanged part of the trees is neither read beyond its own entry nor shuffled.  A directory that
    is only on one side is opened as well, so all its files are listed.  ``change`` is
    added, removed or changed; a name that is a file on one side and a directory on the other is
    removed as the one and added as the other.  Of a path that is there several times, its
    copies count as one file that changed if the sorted list of their digests did.
    """
    both = [materialize(x, "entries") for x in (before, after)]
    keys = ["repo", "dir", "name", "kind"]

    def grouped(side: int, open_: DataFrame | None, depth: int) -> DataFrame:
        rows = both[side].where(F.col("depth") == depth)
        if open_ is not None:
            rows = rows.join(open_, ["repo", "dir"], "left_semi")
        rows = rows.withColumn("dir", F.coalesce("dir", F.lit("\x00")))  # the root's own entry
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("digest")).alias(f"d{side}"))

    found, open_, depth = [], None, -1
    while True:
        level = grouped(0, open_, depth).join(grouped(1, open_, depth), keys, "full").where(
            "NOT (d0 <=> d1)")
        path = F.when(F.col("dir").isin("\x00", ROOT), F.col("name")).otherwise(
            F.concat_ws("/", "dir", "name"))
        change = F.when(F.col("d0").isNull(), "added").when(F.col("d1").isNull(), "removed").otherwise(
            "changed")
        level = materialize(level.select("repo", path.alias("path"), "kind", change.alias("change")),
                            "changes")
        found.append(level)
        open_ = level.where("kind = 'directory'").select("repo", F.col("path").alias("dir"))
        if open_.isEmpty():
            break
        depth += 1
    changes = found[0]
    for more in found[1:]:
        changes = changes.unionByName(more)
    return changes
