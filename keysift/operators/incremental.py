"""Only what an earlier scan did not report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift import session
from keysift.session import key_filter, materialize

# Bits of the bitmap that rules out hashes of a large baseline: 16 MB whatever the sizes.
BITS = 27
# Fixed value: bits of one bitmap of Spark's bitmap functions.
_BUCKET_BITS = 15


def _position(secret_hash: Column) -> Column:
    """The place of a hash among 2^BITS, from its last hex digits."""
    number = F.conv(F.substring(secret_hash, -8, 8), 16, 10).cast("long")
    return number.bitwiseAND(F.lit((1 << BITS) - 1))


def _bucket(secret_hash: Column) -> Column:
    return F.shiftright(_position(secret_hash), _BUCKET_BITS)


def _bit(secret_hash: Column) -> Column:
    return _position(secret_hash).bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))


def hash_bitmap(hashes: DataFrame) -> DataFrame:
    """(bucket, bitmap): a bit for every ``secret_hash``, in at most 2^12 rows of 4 KB."""
    return hashes.where(F.col("secret_hash").isNotNull()).groupBy(
        _bucket(F.col("secret_hash")).alias("bucket")).agg(
        F.bitmap_construct_agg(_bit(F.col("secret_hash"))).alias("bitmap"))


def possibly_in(hashes: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows whose ``secret_hash`` has its bit set: all that are in, and few others.

    The bitmap is 16 MB at most, so it is broadcast and the rows are not shuffled.
    """
    bit = F.col("_bit")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    marked = hashes.withColumn("_bit", _bit(F.col("secret_hash"))).withColumn(
        "bucket", _bucket(F.col("secret_hash"))).join(F.broadcast(bitmaps), "bucket")
    is_set = F.expr("getbit(_byte, cast(_bit % 8 AS INT))") == 1
    return marked.withColumn("_byte", byte.cast("long")).where(is_set).select(*hashes.columns)


def new_findings(
    findings: DataFrame, baseline: DataFrame, deduplicated: bool = False
) -> DataFrame:
    """Findings whose hash is not in ``baseline(secret_hash)``; a null hash is always new.

    A baseline that was counted and is too large to be broadcast is first reduced to the hashes that
    may be among the findings, by a bitmap of theirs; the findings are stored for that.
    Deduplicated findings hold a hash once and are already partitioned by it, so
    a plain anti join moves only the baseline.  Otherwise one hash may fill a
    third of the rows, and the join is broadcast or salted by measured size.
    """
    known = materialize(baseline.select("secret_hash").where("secret_hash IS NOT NULL"), "baseline")
    if known.count() > session.BROADCAST_ROWS:
        findings = materialize(findings, "found")
        known = materialize(possibly_in(known, hash_bitmap(findings)), "known")
    if deduplicated:
        kept = findings.join(known, "secret_hash", "left_anti")
    else:
        spread_by = ["repo", "path", "line"]
        kept = key_filter(findings, known, "secret_hash", "left_anti", spread_by)
    return kept.select(*findings.columns)
