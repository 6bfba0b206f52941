"""Line deduplication over a suffix array of line numbers.

The lines of all documents are one sequence of numbers, cut at document ends and at lines that
occur once, since no repeated run crosses those.  Prefix doubling sorts its suffixes: step k
gives every block of 2^k lines its rank among the blocks, from the ranks of its two halves;
blocks that occur once are dropped on the way.  Two suffixes have a common prefix of 2^k lines
exactly if their ranks of step k are equal, and of any number of lines if the ranks of the two
overlapping blocks that cover them are.

A run counts as repeated if it has at least ``min_words`` words.  Any such run is covered by the
shortest prefixes and suffixes of that many words that begin or end inside it, so the intervals
of suffixes that agree on one of these show every maximal repeated run without a bound on
its length.  In each interval the earliest place is kept, the others are later copies, and
the lines that some later copy covers are deleted.

"Earlier" goes by doc_id (null last), then by the place of the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.llm.common import DOCUMENT, materialize, read_table, slices, with_place, word_count

MIN_WORDS = 50


def _ranked(keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct ``keys`` with ``r``, a number that rises with the columns."""
    keys = materialize(keys, "keys")  # finding the ranges reads them once more
    ranges = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(ranges.withColumn("r", F.monotonically_increasing_id()), "ranks")


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(at, doc_id, i, words, r) of each line that occurs more than once; r is its rank.

    ``rows`` has at (unique), doc_id and text.
    """
    lines = rows.select("at", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    lines = lines.select("at", "doc_id", "i", word_count(F.col("line")).alias("words"),
                         F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    lines = materialize(lines, "lines")
    twice = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = _ranked(twice.select("h", "g"), "h", "g")
    return materialize(lines.join(ranks, ["h", "g"]).select("at", "doc_id", "i", "words", "r"),
                       "repeated")


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(at, doc_id, i, m): blocks of m lines from line i that just reach ``min_words``.

    Only blocks of lines that all repeat; the shortest from each line, and the shortest up to it.
    """
    by_line = Window.partitionBy("at").orderBy("i")
    lines = lines.withColumn("run", F.col("i") - F.row_number().over(by_line))
    in_run = Window.partitionBy("at", "run").orderBy("i")
    before = F.coalesce(F.sum("words").over(in_run.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    edges = lines.select("at", "doc_id", "run", "i", before.alias("b"), "words",
                         F.lead("i").over(in_run).isNull().alias("last"))
    # Line ends are edges too: the one after a run's last line has no line of its own.
    line = F.struct("i", "b", F.lit(True).alias("line"))
    end = F.struct((F.col("i") + 1).alias("i"), (F.col("b") + F.col("words")).alias("b"),
                   F.lit(False).alias("line"))
    edges = edges.select("at", "doc_id", "run", F.explode(
        F.when(F.col("last"), F.array(line, end)).otherwise(F.array(line))).alias("e"))
    edges = edges.select("at", "doc_id", "run", "e.*")
    words = Window.partitionBy("at", "run").orderBy("b")
    whole = Window.partitionBy("at", "run")
    near = edges.select(
        "*", F.min("i").over(whole).alias("lowest"), F.max("i").over(whole).alias("highest"),
        (F.max("i").over(words.rangeBetween(0, min_words - 1)) + 1).alias("until"),
        (F.min("i").over(words.rangeBetween(1 - min_words, 0)) - 1).alias("since"))
    forward = near.where("line AND until <= highest").select(
        "at", "doc_id", "i", (F.col("until") - F.col("i")).alias("m"))
    backward = near.where("since >= lowest").select(
        "at", "doc_id", F.col("since").alias("i"), (F.col("i") - F.col("since")).alias("m"))
    return forward.unionByName(backward).distinct()


def doubled(ranks: DataFrame, k: int) -> DataFrame:
    """(at, i, r) of each block of 2^(k+1) lines that repeats, from those of 2^k lines."""
    half = 1 << k
    beyond = Window.partitionBy("at").orderBy("i").rangeBetween(half, half)
    pairs = ranks.withColumn("s", F.max("r").over(beyond)).where("s IS NOT NULL")
    pairs = materialize(pairs.withColumnRenamed("r", "f"), "pairs")
    twice = pairs.groupBy("f", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = _ranked(twice.select("f", "s"), "f", "s")
    return materialize(pairs.join(found, ["f", "s"]).select("at", "i", "r"), "doubled")


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(at, spans) of the documents that lose lines; spans are [begin, end) of line numbers.

    ``rows`` has at (unique), doc_id and text.  Spans may overlap.
    """
    lines = repeated_lines(rows)
    blocks = materialize(windows(lines, min_words), "windows")
    longest = blocks.agg(F.max("m")).first()[0] or 0
    steps = [lines.select("at", "i", "r")]
    while 2 << (len(steps) - 1) <= longest:
        steps.append(doubled(steps[-1], len(steps) - 1))
    suffixes = steps[0].withColumn("k", F.lit(0))
    for k, step in enumerate(steps[1:], 1):
        suffixes = suffixes.unionByName(step.withColumn("k", F.lit(k)))
    k = F.length(F.bin("m")) - 1  # the largest block that fits
    blocks = blocks.withColumn("k", k).withColumn(
        "j", (F.col("i") + F.col("m") - F.expr("shiftleft(1, k)")).cast("int"))
    head = suffixes.withColumnRenamed("r", "head")
    tail = suffixes.select("at", "k", F.col("i").alias("j"), F.col("r").alias("tail"))
    known = materialize(blocks.join(head, ["at", "k", "i"]).join(tail, ["at", "k", "j"]).select(
        "at", "i", "m", "head", "tail",
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "i").alias("place")),
        "intervals")
    first = known.groupBy("m", "head", "tail").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = known.join(materialize(first, "first"), ["m", "head", "tail"]).where("place != first")
    ends = later.groupBy("at", "i").agg(F.max(F.col("i") + F.col("m")).alias("end"))
    return materialize(ends.groupBy("at").agg(
        F.collect_list(F.struct(F.col("i").alias("begin"), "end")).alias("spans")), "spans")


def cut(text: str | None, spans: list[dict] | None) -> tuple[str | None, int, list[tuple[int, int]]]:
    """What is left of a text, its number of lines and the joined runs of deleted lines."""
    if text is None:
        return None, 0, []
    lines = text.split("\n")
    if not spans:
        return text, len(lines), []
    steps = np.zeros(len(lines) + 1, np.int64)
    np.add.at(steps, [s["begin"] for s in spans], 1)
    np.add.at(steps, [s["end"] for s in spans], -1)
    gone = np.concatenate(([0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(gone)).tolist()
    left = "\n".join(x for x, d in zip(lines, gone[1:-1].tolist()) if not d)
    return left, len(lines), list(zip(edges[::2], edges[1::2]))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, n_deleted, runs, left): ``docs`` (row, text) without later copies.

    ``row`` is a struct with ``doc_id``; ``left`` is whether any line is left.  ``runs`` are the
    deleted lines, as [begin, end).  Lines end at "\\n" only; a null text has no lines and
    stays null, an empty one has one empty line.  Runs below ``min_words`` words stay.  Of repeated
    rows all but one lose their repeated runs.  An empty table gives no rows.
    """
    rows = with_place(docs.select("row", "text"))
    spans = later_copies(rows.select("at", F.col("row.doc_id").alias("doc_id"), "text"), min_words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [cut(t, s) for t, s in zip(
                    part.column("text").to_pylist(), part.column("spans").to_pylist())]
                gone = [sum(b - a for a, b in x[2]) for x in found]
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.int64()), pa.array(gone, pa.int64()),
                    pa.array([",".join(f"{a}:{b}" for a, b in x[2]) for x in found], pa.string()),
                    pa.array([not n or n < x[1] for n, x in zip(gone, found)], pa.bool_()),
                ], ["row", "text", "n_lines", "n_deleted", "runs", "left"])

    kind = docs.schema["row"].dataType.simpleString()
    # Texts are shuffled once at every size; whether the spans could be broadcast is left out of it.
    return rows.join(spans.hint("merge"), "at", "left").select("row", "text", "spans").mapInArrow(
        task, f"row {kind}, text string, n_lines long, n_deleted long, runs string, left boolean")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, runs (begin:end of deleted lines) and kept_sha256."""
    docs = read_table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("row"), "text")
    return line_dedup(docs).select(
        "row.doc_id", "n_lines", "n_deleted", "runs",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_later_copies(docs: DataFrame) -> DataFrame:
    """The documents without later copies of repeated runs.

    A document that loses all its lines goes; n_chars is counted anew where lines went.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias(DOCUMENT)).alias("row"), "text")
    found = line_dedup(rows).where("left")
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(
        F.col("row.n_chars"))
    return found.select(f"row.{DOCUMENT}.*", "text", n_chars.alias("n_chars")).select(
        *[F.col(f"`{c}`") for c in docs.columns])
