"""Document fingerprints: a digest of bucket quartiles, compared by a bounded difference.

Three byte triplets are taken at each place of a text's UTF-8 (the byte with the next two, with
the next and the fourth, and with the third and the fourth) and hashed into 256 buckets.
The digest holds the logarithm of the length, the quartiles' ratios, and for every
bucket in which quarter of the buckets its count lies (two bits).  Equal texts have equal digests.

The difference of two digests adds the steps between their length codes and ratios and between
their buckets' quarters, where a step over the whole range counts double; it is bounded, and
likeness is one less its share of the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import read_table, slices

BUCKETS = 256
_PERMUTATION = np.random.Generator(np.random.PCG64(4)).permutation(256).astype(
    np.uint8).tobytes()
_BYTES_AT_A_TIME = 1 << 20
# Most that a part of the header and a bucket can add.
_HEADER_MOST, _BUCKET_MOST = 12, 4
_MOST = 3 * _HEADER_MOST + BUCKETS * _BUCKET_MOST
_STEP = np.array([0, 1, 2, _BUCKET_MOST])
ROWS_IN_RANGE = 2_000
# Ranges are streams of any length; this bounds the list of cuts.
_MOST_RANGES = 8_192


def _mix(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(x.tobytes().translate(_PERMUTATION), np.uint8)


def _counts(data: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 2, 0), _BYTES_AT_A_TIME):
        x = np.frombuffer(data, np.uint8, min(_BYTES_AT_A_TIME + 3, len(data) - at), at)
        n = min(_BYTES_AT_A_TIME, x.size - 2)  # places that begin here, with two bytes after them
        m = min(n, x.size - 3)
        first = _mix(x)
        pair = _mix(first[:n] ^ x[1:n + 1])
        total += np.bincount(_mix(pair ^ x[2:n + 2]), minlength=BUCKETS)
        if m > 0:
            total += np.bincount(_mix(pair[:m] ^ x[3:m + 3] ^ 0x55), minlength=BUCKETS)
            pair = _mix(first[:m] ^ x[2:m + 2] ^ 0xAA)
            total += np.bincount(_mix(pair ^ x[3:m + 3]), minlength=BUCKETS)
    return total


def digest(data: bytes) -> np.ndarray:
    """Length code, two ratios and the quarter of each bucket, as small integers."""
    counts = _counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    length = min(255, round(6 * np.log2(1 + len(data))))
    ratios = [int(15 * q / q3) if q3 else 0 for q in (q1, q2)]
    quarters = (counts > q1).astype(np.int16) + (counts > q2) + (counts > q3)
    return np.concatenate(([length, *ratios], quarters)).astype(np.int16)


def to_text(found: np.ndarray) -> str:
    """``D1``, length code, ratios, then four buckets to a byte, as hex."""
    a, b, c = found[:3].tolist()
    packed = found[3:].reshape(-1, 4) @ np.array([64, 16, 4, 1])
    return f"D1{a:02x}{b:x}{c:x}" + packed.astype(np.uint8).tobytes().hex()


def from_text(text: str) -> np.ndarray:
    if not text.startswith("D1") or len(text) != 6 + BUCKETS // 2:
        raise ValueError("no digest of this kind")
    packed = np.frombuffer(bytes.fromhex(text[6:]), np.uint8)
    quarters = (packed[:, None] >> np.array([6, 4, 2, 0])) & 3
    head = [int(text[2:4], 16), int(text[4], 16), int(text[5], 16)]
    return np.concatenate((head, quarters.ravel())).astype(np.int16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, down to 0 for the largest difference."""
    apart = np.abs(a - b)
    steps = int(np.minimum(apart[:3], _HEADER_MOST).sum()) + int(_STEP[apart[3:]].sum())
    return 1.0 - steps / _MOST


def edited(text: str, donor: str) -> str:
    """The text with its last third replaced by as much of the beginning of another."""
    third = len(text) // 3
    return text[:len(text) - third] + donor[:third]


OUTPUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def compare_with_next(docs: DataFrame, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """Digests of every text, its edited text, and likeness to that and to the next document.

    ``docs`` has doc_id (long) and text.  Documents follow one another by descending doc_id, rows
    of one id by text; a null text counts as empty, a null doc_id comes after all others.  After the
    last row comes the first again, so a single row is its own next.

    The ids are cut into ranges of about ``rows_in_range`` rows.  A range is sorted and read as a
    stream, in which each row only needs the one after it; the first id of each range is sent
    to the range before as well.  The texts are shuffled once.
    """
    docs = docs.select("doc_id", "text")
    n, top = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    wanted = min(max(1, n // rows_in_range), _MOST_RANGES)
    cuts = [1 - i / wanted for i in range(wanted)]  # the largest id first
    tops = docs.agg(F.percentile_approx("doc_id", cuts, 10 * wanted + 1000).alias("x")).first()["x"]
    tops = sorted(set(tops or []), reverse=True)
    if n:
        tops[0] = top
    rising = np.array(tops[::-1], np.int64)
    parts = max(1, len(tops))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Range of each row; kind 1 is the beginning of the next range, 2 that of the first."""
        for batch in batches:
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            at = parts - 1 - np.searchsorted(rising, ids)
            at[null] = parts - 1
            first = np.zeros(ids.size, bool)
            if rising.size:
                first = (ids == rising[::-1][np.clip(at, 0, parts - 1)]) & ~null
            rows = np.concatenate((np.arange(ids.size), np.flatnonzero(first)))
            to = np.concatenate((at, (at[first] - 1) % parts))
            kind = np.concatenate((np.zeros(ids.size), np.where(at[first] == 0, 2, 1)))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(kind, pa.int32()), *taken.columns],
                ["part", "kind", "doc_id", "text"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order; each is finished when the next one comes."""
        held = begun = None  # (part, doc_id, text, digest)
        done: list[tuple] = []

        def finish(row: tuple, after: tuple) -> None:
            _, doc_id, text, mine = row
            changed = edited(text, after[2]).encode("utf-8")
            other = digest(changed)
            done.append((doc_id, len(text), hashlib.sha256(changed).hexdigest(), to_text(mine),
                         to_text(other), likeness(mine, other), likeness(mine, after[3])))

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in OUTPUT.split(", ")]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            columns = zip(*done) if done else [()] * len(names)
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names)
            done.clear()
            return out

        for batch in batches:
            for piece in slices(batch):
                for part, kind, doc_id, text in zip(*(c.to_pylist() for c in piece.columns)):
                    text = text or ""
                    row = (part, doc_id, text, digest(text.encode("utf-8")))
                    if held is not None and held[0] != part:
                        finish(held, begun)  # only without any id: one range, no row sent on
                        held = None
                    if held is not None:
                        finish(held, row)
                        held = None
                    if kind == 0:
                        begun = row if begun is None or begun[0] != part else begun
                        held = row
                yield flush()
        if held is not None:
            finish(held, begun)
        yield flush()

    placed = docs.mapInArrow(place, "part int, kind int, doc_id long, text string")
    ordered = placed.repartition(parts, "part").sortWithinPartitions(
        "part", "kind", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(follow, OUTPUT)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and likenesses of every document, its edited text and the next document."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))
