"""SimHash near-duplicates: fingerprints, blocks shared by close pairs, components.

Texts are lower-cased (A-Z), cut into words and shingles; a bit of the 64-bit fingerprint is set
if more than half of the shingle hashes have it.  Equal fingerprints are one node.  The
bits are split into ``max_bits + 3`` blocks, so two fingerprints that differ in at most
``max_bits`` share at least three blocks whole; they meet in the bucket of some three blocks
and are compared there.  A bucket of few fingerprints is joined with itself.  One of many
is not: its members agree on the three blocks, so each is filed under itself and every
fingerprint with one other bit flipped, and those that meet there are linked in a star.  Two
fingerprints at distance two have the two in the middle in common, so no link is lost and the
rows grow with the bucket and not with its square.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import DOCUMENT, byte_lists, materialize, read_table, slices, with_place
from keysift.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
# Buckets of more fingerprints are linked by flipped bits; about where that is less work.
PAIRED_BUCKET = 48
_SHARED = 3
_HASHES_AT_A_TIME = 1 << 16


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text as a signed integer; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(words_in_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _HASHES_AT_A_TIME):
        part = [digest(joined[a:b], SEED) for a, b in
                zip(starts[at:at + _HASHES_AT_A_TIME], ends[at:at + _HASHES_AT_A_TIME])]
        rows = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(row, fingerprint long) for each row; ``row`` is the struct of all other columns.

    ``docs`` has ``text`` and a column ``row``.  A null text counts as empty.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [fingerprint(x, words_in_shingle) for x in byte_lists(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(found, pa.int64())], ["row", "fingerprint"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(task, f"row {kind}, fingerprint long")


def _blocks(max_bits: int) -> list[int]:
    """Masks of the blocks, as even as can be."""
    edges = np.linspace(0, 64, max_bits + _SHARED + 1).round().astype(int)
    return [((1 << int(b - a)) - 1) << int(a) for a, b in itertools.pairwise(edges)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) between fingerprints whose components are those of distance <= max_bits.

    ``distinct`` has each fingerprint once.  The star of a large bucket stands for its pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    masks = [sum(c) for c in itertools.combinations(_blocks(max_bits), _SHARED)]
    buckets = distinct.select("fingerprint", F.posexplode(F.array(*[
        F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "key"))
    sizes = buckets.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # The stored sizes let the adaptive join split a bucket that holds a large part of the rows.
    buckets = materialize(
        buckets.join(materialize(sizes, "sizes"), ["mask", "key"]), "buckets")
    small = buckets.where(F.col("n") <= PAIRED_BUCKET)
    left = small.select("mask", "key", F.col("fingerprint").alias("u"))
    right = small.select("mask", "key", F.col("fingerprint").alias("v"))
    pairs = left.join(right, ["mask", "key"]).where((F.col("u") > F.col("v")) & (
        _apart("u", "v") <= max_bits)).select("u", "v")
    # One flip reaches the middle of a pair two bits apart; a pair one bit apart is met at either end.
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[
        F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in masks])
    flips = F.element_at(flips, F.col("mask") + 1) if max_bits else F.array(F.lit(0).cast("long"))
    filed = buckets.where(F.col("n") > PAIRED_BUCKET).select(
        "mask", "fingerprint", F.explode(flips).alias("flip"))
    met = filed.groupBy("mask", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle")).agg(
        F.collect_set("fingerprint").alias("near"))  # the middle and those one bit off, 65 at most
    if max_bits == 1:  # only those one bit from the middle itself are near each other
        met = met.where(F.array_contains("near", F.col("middle")))
    stars = met.where(F.size("near") > 1).select(
        F.explode("near").alias("u"), F.array_min("near").alias("v")).where("u != v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(row, fingerprint, component_id, label: long) of every row of ``docs`` (row, text).

    ``row`` is a struct with ``doc_id``.  Two fingerprints link if at most ``max_bits`` bits differ;
    component_id is the smallest doc_id among all rows reachable over links, the row's own
    included, and label the least fingerprint among them.  Null and wordless texts have fingerprint zero and link like any other.  Rows
    with a null doc_id take part, but never name a component; it is null if no row of
    the component has an id.  Repeated rows stay repeated.  An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, words_in_shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fingerprint").agg(
        F.min("row.doc_id").alias("least_id")), "distinct")
    labels = components(links(distinct, max_bits))
    linked = materialize(
        distinct.join(labels, F.col("fingerprint") == F.col("node")).select(
            "fingerprint", "label", "least_id"), "linked")
    roots = materialize(linked.groupBy("label").agg(F.min("least_id").alias("root_id")), "roots")
    linked = linked.join(roots, "label").select(F.col("fingerprint").alias("node"), "label", "root_id")
    named = distinct.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root_id", "least_id").alias("component_id"),
        F.coalesce("label", "fingerprint").alias("label"))
    return marked.join(materialize(named, "named"), "fingerprint")


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    docs = read_table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("row"), "text")
    return near_duplicates(docs).select(
        "row.doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one left of each component: a row with the component's smallest id.

    Of repeated rows with that id, and in components without any id, one row stays too.
    """
    rows = with_place(docs.select("doc_id", "text", F.struct(
        *[F.col(f"`{c}`") for c in docs.columns]).alias(DOCUMENT)))
    kept = near_duplicates(rows.select(F.struct("doc_id", "at").alias("row"), "text")).groupBy("label").agg(F.min(F.struct(
        F.col("row.doc_id").isNull(), "row.doc_id", "row.at")).alias("first"))
    kept = materialize(kept.select(F.col("first.at").alias("kept_at")), "kept")
    return rows.select("at", DOCUMENT).join(
        kept.hint("merge"), F.col("at") == F.col("kept_at")).select(f"{DOCUMENT}.*")
