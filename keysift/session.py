"""Session-level helpers: scratch folder, scan parallelism, size-checked joins."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when both counts were measured and are below these.
BROADCAST_ROWS = 500_000
BROADCAST_KEY_BYTES = 64 * 1024 * 1024
# A larger key table is repeated once per salt, but not beyond so many rows.
SALTS = 32
SALTED_ROWS = 8_000_000


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="keysift-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local master may run without it; a cluster has to name a folder that
    every executor can reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_scratch()


def new_scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it back.

    Several consumers can then share the rows without repeating the scan, and a
    lost executor costs one task instead of the whole lineage.
    """
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system and path of a path, as Spark's own readers resolve it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def delete_folder(spark: SparkSession, path: str) -> None:
    system, found = _path(spark, path)
    system.delete(found, True)


def join_files(
    spark: SparkSession, folder: str, target: str, head: bytes, tail: bytes, skipped: int = 0
) -> None:
    """One file of ``head``, the part files of a folder in the order of their names, and ``tail``.

    The first ``skipped`` bytes of the parts are left out.  Bytes go from stream to stream; the
    file is written under another name and then renamed.
    """
    system, at = _path(spark, target)
    source, parts = _path(spark, folder)
    hidden = _path(spark, f"{target}.{uuid.uuid4().hex}")[1]
    hadoop = spark._jvm.org.apache.hadoop
    names = sorted(x.getPath().getName() for x in source.listStatus(parts)) if source.exists(
        parts) else []
    out = system.create(hidden, True)
    try:
        out.write(head)
        for name in names:
            if not name.startswith("part-"):
                continue
            read = source.open(hadoop.fs.Path(parts, name))
            try:
                while skipped and read.read() >= 0:
                    skipped -= 1
                hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
            finally:
                read.close()
        out.write(tail)
    finally:
        out.close()
    system.delete(at, True)
    if not system.rename(hidden, at):
        raise OSError(f"cannot write {target}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all task slots when a scan would leave most of them idle.

    A table in a few files (or one large row group) is read by a few tasks.
    Such a small input is redistributed by ``keys``.  An input whose files or
    splits keep at least half of the slots busy is left alone, so large inputs
    are never shuffled here.
    """
    if df.isStreaming:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.rdd.getNumPartitions()
    if tasks >= 4 * slots:
        return df
    if min(tasks, len(df.inputFiles())) * 2 > slots:
        return df
    return df.repartition(slots, *keys)


def _measure(keys: DataFrame, key: str) -> tuple[int, int]:
    """Rows and key bytes of a table."""
    found = keys.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("size"),
    ).first()
    return found["n"], found["size"]


def join_keys(
    df: DataFrame,
    keys: DataFrame,
    key: str,
    how: str,
    spread_by: Sequence[str],
    broadcast: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join wide rows that may have hot keys with a table that is unique on ``key``.

    The table is stored first, so that measuring it does not repeat what it comes
    from.  A small one is broadcast and the wide side does not move.  A middling
    one is joined on (key, salt): the rows of a hot key are dealt over salts by a
    hash of ``spread_by`` and the table is repeated once per salt, up to
    ``SALTED_ROWS`` in all.  Beyond that both sides are shuffled by key alone, and
    since the stored table is shuffled straight from its files, the adaptive skew
    join can split the partition of a hot key.
    """
    if broadcast is None:
        keys = materialize(keys, "keys")
        rows, size = _measure(keys, key)
        broadcast = rows <= BROADCAST_ROWS and size <= BROADCAST_KEY_BYTES
        salts = min(salts, SALTED_ROWS // max(rows, 1))
    if broadcast:
        return df.join(F.broadcast(keys), key, how)
    if salts < 2:
        return df.join(keys, key, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return df.withColumn("_salt", salt).join(
        keys.withColumn("_salt", every_salt), [key, "_salt"], how).drop("_salt")


def key_filter(
    df: DataFrame, keys: DataFrame, key: str, how: str, spread_by: Sequence[str], **options: object
) -> DataFrame:
    """Keep (``left_semi``) or drop (``left_anti``) rows whose ``key`` is in ``keys``."""
    kept = join_keys(df, keys.select(key).distinct(), key, how, spread_by, **options)
    return kept.select(*df.columns)
