"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.session import materialize, new_scratch

__all__ = ["materialize", "new_scratch", "read_table", "remainder", "slices", "byte_lists",
           "with_place",
           "word_count", "DOCUMENT"]

# Bytes of text that a task holds in Python objects at a time.
SLICE_BYTES = 4 << 20
# A whole row travels under this name, so that its own columns cannot clash with ours.
DOCUMENT = "_document"
# The white space that parts words.
WORD_GAPS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def word_count(text: Column) -> Column:
    """Number of words, in memory that follows the text and not the number of words."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marked, WORD_GAPS, "")).cast("long")


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with ``at``, which tells its rows apart and is the same whenever they are read.

    Rows of files are told apart by file and place in it.  Rows that come from elsewhere are stored
    and numbered.
    """
    try:
        place = df.metadataColumn("_metadata")
        found = df.withColumn("at", F.struct(
            F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("number")))
        found.schema  # noqa: B018  raises if the rows are not those of files
        return found
    except AnalysisException:
        number = F.monotonically_increasing_id()
        return materialize(df.withColumn("at", F.struct(
            F.lit(0).cast("long").alias("file"), number.alias("number"))), "rows")


def slices(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in a column; a longer text is a part alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def byte_lists(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a text column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def long_array(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.int64), pa.int64(), mask=mask)
