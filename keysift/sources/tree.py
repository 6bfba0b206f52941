"""Directory trees, hidden files included.

Spark's own file sources leave out every name that starts with a dot or an
underscore, and credentials live in ``.env``, ``.npmrc`` and ``__init__.py``.  So a
tree is listed and read by small tasks of its own: one job per directory level
lists all directories of that level in parallel, the rules on depth, size and
path act on the listing, and only then is content read.

``root`` is a path every executor can reach, or a URI that Arrow can open.
Symbolic links are not followed.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions import paths
from keysift.options import ScanOptions
from keysift.session import new_scratch

LISTING = "path STRING, size BIGINT, is_dir BOOLEAN, error STRING"
_READ = "repo STRING, path STRING, size BIGINT, content BINARY"
_LIST_ROWS = 10_000
# Content handed over at a time, and content per task.
_CHUNK_BYTES = 16 * 1024 * 1024
_TASK_BYTES = 64 * 1024 * 1024

_Batches = Iterator[pd.DataFrame]


# The task functions are nested, so they travel to the workers whole and this
# package need not be installed there.


def _lister(root: str) -> Callable[[_Batches], _Batches]:
    """A task that lists the directories it is given."""

    def local_entries(directory: str) -> Iterator[tuple]:
        with os.scandir(directory) as found:
            for entry in found:
                if entry.is_symlink():
                    continue
                is_dir = entry.is_dir()
                if is_dir or entry.is_file():
                    yield entry.name, None if is_dir else entry.stat().st_size, is_dir

    def remote_entries(directory: str) -> Iterator[tuple]:
        system, inside = arrow_fs.FileSystem.from_uri(directory)
        for info in system.get_file_info(arrow_fs.FileSelector(inside)):
            is_dir = info.type == arrow_fs.FileType.Directory
            yield info.base_name, None if is_dir else info.size, is_dir

    def rows_of(directory: str) -> Iterator[tuple]:
        entries = remote_entries if "://" in root else local_entries
        try:
            for name, size, is_dir in entries(f"{root}/{directory}".rstrip("/") or "/"):
                error, storable = None, name.encode("utf-8", "replace").decode()
                if storable != name:
                    # The name cannot be kept as text and used to open the file later.
                    error = "name is not UTF-8"
                yield f"{directory}/{storable}".lstrip("/"), size, is_dir, error
        except OSError as problem:
            yield directory, None, True, str(problem)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = ["path", "size", "is_dir", "error"]
        return pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    def list_all(batches: _Batches) -> _Batches:
        rows: list[tuple] = []
        for batch in batches:
            for directory in batch["path"]:
                for row in rows_of(directory):
                    rows.append(row)
                    if len(rows) >= _LIST_ROWS:
                        yield frame(rows)
                        rows = []
        yield frame(rows)

    return list_all


def _reader(root: str) -> Callable[[_Batches], _Batches]:
    """A task that adds the content of the files it is given."""

    def read(file: str) -> bytes | None:
        try:
            if "://" not in file:
                with open(file, "rb") as source:
                    return source.read()
            system, inside = arrow_fs.FileSystem.from_uri(file)
            with system.open_input_stream(inside) as source:
                return source.read()
        except OSError:
            return None

    def read_all(batches: _Batches) -> _Batches:
        columns = ["repo", "path", "size", "content"]
        rows, held = [], 0
        for batch in batches:
            for repo, path, size in zip(batch["repo"], batch["path"], batch["size"]):
                content = read(f"{root.rstrip('/')}/{path}")
                rows.append((repo, path, size, content))
                held += len(content or b"")
                if held >= _CHUNK_BYTES or len(rows) >= _LIST_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return read_all


PIECES = (
    "repo STRING, path STRING, size BIGINT, first_line BIGINT, first_char BIGINT, low INT, high INT, "
    "low_line INT, low_char INT, high_line INT, high_char INT, content STRING")


def _piece_reader(root: str, piece: int, overlap: int) -> Callable[[_Batches], _Batches]:
    """A task that reads files piece by piece, whatever their size."""

    def opened(file: str):
        if "://" not in file:
            return open(file, "rb")
        system, inside = arrow_fs.FileSystem.from_uri(file)
        return system.open_input_file(inside)

    def border(data: bytes, wanted: int) -> int:
        """Where a piece ends: behind a line end, or else between two characters."""
        cut = data.rfind(b"\n", 0, wanted) + 1
        if cut:
            return cut
        cut = wanted
        while cut > 1 and cut < len(data) and (data[cut] & 0xC0 == 0x80 or data[cut - 1:cut + 1] == b"\r\n"):
            cut -= 1
        return cut

    def end(text: str) -> tuple[int, int]:
        """Line ends in a text, and characters behind the last one."""
        plain = text.replace("\r\n", "\n").replace("\r", "\n")
        return plain.count("\n"), len(plain) - plain.rfind("\n") - 1

    def pieces_of(file: str) -> Iterator[tuple]:
        line = char = 0
        with opened(file) as source:
            left, ahead = b"", source.read(piece + overlap)
            while True:
                size = len(ahead) if len(ahead) < piece + overlap else border(ahead, piece)
                own, right = ahead[:size], ahead[size:]
                texts = [x.decode("utf-8", "replace") for x in (left, own, right)]
                low, high = len(texts[0]), len(texts[0]) + len(texts[1])
                yield (line, char, low, high, *end(texts[0]), *end(texts[0] + texts[1]), "".join(texts))
                if not right and len(ahead) < piece + overlap:
                    return
                line, char = line + end(texts[1])[0], char + len(texts[1])
                left = (left + own)[-overlap:]
                # The left side begins behind a line end where it holds one, else with a character.
                at = left.find(b"\n") + 1 if left.find(b"\n") + 1 < len(left) else 0
                while at < len(left) and left[at] & 0xC0 == 0x80:
                    at += 1
                left = left[at:]
                ahead = right + source.read(piece + overlap - len(right))

    def read_all(batches: _Batches) -> _Batches:
        columns = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            for repo, path, size in zip(batch["repo"], batch["path"], batch["size"]):
                try:
                    for found in pieces_of(f"{root.rstrip('/')}/{path}"):
                        yield pd.DataFrame([(repo, path, size, *found)], columns=columns)
                except OSError:
                    yield pd.DataFrame([(repo, path, size, *[None] * 9)], columns=columns).astype(
                        {c.split()[0]: "Int64" for c in PIECES.split(", ")[3:11]})

    return read_all


def read_pieces(
    spark: SparkSession, root: str, listing: DataFrame, piece: int = 4 << 20, overlap: int = 128 << 10,
    repo: str = "local",
) -> DataFrame:
    """The files of a listing (path, size, and repo if it names one) in overlapping pieces.

    A row is a piece with ``overlap`` bytes on both sides: ``low`` to ``high`` are the characters that
    are its own, also given by line and character in the line, and ``first_line`` and ``first_char``
    count what lies before them in the file.  A piece ends behind a line end if it holds one.
    Files are read as streams, so memory follows the piece and not the file; a file that cannot be
    read gives one row without content.
    """
    if overlap < 1 or piece < overlap:
        raise ValueError("a piece must not be smaller than the overlap, nor that than 1")
    owner = F.col("repo") if "repo" in listing.columns else F.lit(repo).alias("repo")
    wanted = listing.where("NOT is_dir AND error IS NULL").select(owner, "path", "size")
    total = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // _TASK_BYTES))
    return wanted.repartition(tasks, "path").mapInPandas(
        _piece_reader(root.rstrip("/") or "/", piece, overlap), PIECES)


def over_limit(listing: DataFrame, options: ScanOptions) -> DataFrame:
    """The files of a listing that ``scan_tree`` leaves out for their size alone."""
    kept = listing.where("NOT is_dir AND error IS NULL").where(
        F.col("size") > options.max_file_size_mb * 1024 * 1024)
    if options.max_depth is not None:
        kept = kept.where(paths.depth(F.col("path")) <= options.max_depth)
    return kept.where(~paths.is_skipped(F.col("path"), options.skip_fragments))


def list_tree(
    spark: SparkSession, root: str, max_depth: int | None = None,
    skip_fragments: tuple[str, ...] = (),
) -> DataFrame:
    """All files and directories below ``root`` (path, size, is_dir, error).

    A root that cannot be listed is an error.

    Directories under a skip fragment appear but are not entered; those that
    cannot be listed carry an error.  Levels are stored in the scratch folder.
    """
    root = root.rstrip("/") or "/"
    slots = spark.sparkContext.defaultParallelism
    stored = new_scratch(spark, "listing")
    level, depth = spark.createDataFrame([("",)], "path STRING"), 0
    while True:
        target = f"{stored}/level={depth}"
        level.select("path").mapInPandas(_lister(root), LISTING).write.parquet(target)
        listed = spark.read.schema(LISTING).parquet(target)
        if depth == 0 and (failed := listed.where("path = '' AND error IS NOT NULL").first()):
            raise FileNotFoundError(f"{root} cannot be listed: {failed['error']}")
        directories = listed.where("is_dir AND error IS NULL")
        inside = F.concat(F.col("path"), F.lit("/"))
        level = directories.where(~paths.is_skipped(inside, skip_fragments))
        if depth == max_depth or level.isEmpty():
            break
        level, depth = level.repartition(slots, "path"), depth + 1
    return spark.read.schema(LISTING).parquet(*[f"{stored}/level={n}" for n in range(depth + 1)])


def scan_tree(
    spark: SparkSession, root: str, options: ScanOptions, repo: str = "local",
    listing: DataFrame | None = None,
) -> DataFrame:
    """Every file below ``root`` that the options admit as (repo, path, size, content).

    A listing may name the repository of each file in a column ``repo``.

    Content is null for a file that cannot be read, and bytes that are not UTF-8
    are replaced: neither a lock nor a binary file fails the scan.
    """
    root = root.rstrip("/") or "/"
    if listing is None:
        listing = list_tree(spark, root, options.max_depth, options.skip_fragments)
    wanted = listing.where("NOT is_dir AND error IS NULL").where(
        F.col("size") <= options.max_file_size_mb * 1024 * 1024)
    if options.max_depth is not None:
        wanted = wanted.where(paths.depth(F.col("path")) <= options.max_depth)
    wanted = wanted.where(~paths.is_skipped(F.col("path"), options.skip_fragments))
    total = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // _TASK_BYTES))
    owner = F.col("repo") if "repo" in wanted.columns else F.lit(repo).alias("repo")
    read = wanted.select(owner, "path", "size").repartition(tasks, "path").mapInPandas(
        _reader(root), _READ)
    return read.select(
        "repo", "path", "size",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def tree_roots(listing: DataFrame) -> DataFrame:
    """Repository roots of a listing: directories that hold a ``.git`` directory."""
    name = F.concat(F.lit("/"), F.col("path"))
    root = F.substring(name, F.lit(1), F.length(name) - len("/.git"))
    return listing.where(F.col("is_dir") & name.endswith("/.git")).select(
        F.ltrim(root, F.lit("/")).alias("root")).distinct()


def unscanned(
    listing: DataFrame, options: ScanOptions, files: DataFrame | None = None
) -> DataFrame:
    """(path, reason) of what a scan of the listing leaves out without a rule on paths for it.

    Directories that cannot be listed, names that cannot be kept and files over the size limit come
    from the listing; with ``files``, the rows of ``scan_tree``, also files that could not be read.
    """
    limit = options.max_file_size_mb * 1024 * 1024
    kept = listing.where(~paths.is_skipped(F.col("path"), options.skip_fragments))
    reason = F.coalesce("error", F.when(~F.col("is_dir") & (F.col("size") > limit), "too large"))
    found = kept.select("path", reason.alias("reason")).where("reason IS NOT NULL")
    if files is not None:
        unread = files.where("content IS NULL").select("path", F.lit("cannot be read").alias("reason"))
        found = found.unionByName(unread)
    return found
