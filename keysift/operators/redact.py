"""Secrets replaced in the text that holds them."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.catalog import PATTERNS, Pattern
from keysift.functions import prefilter
from keysift.functions.spans import secret_spans

REPLACEMENT = "***REMOVED***"


def _redact(text: Column, patterns: Iterable[Pattern], replacement: str) -> Column:
    """The text with every secret replaced; secrets that overlap are one, whatever found them first."""
    spans = F.array_sort(F.flatten(F.array(*[secret_spans(text, p) for p in patterns])))

    def splice(done: Column, span: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, span["s"] - done["at"])
        return F.when(span["s"] < done["at"], F.struct(
            F.greatest(done["at"], span["e"]).alias("at"), done["out"].alias("out"))).otherwise(
            F.struct(span["e"].alias("at"),
                     F.concat(done["out"], kept, F.lit(replacement)).alias("out")))

    return F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), splice,
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


# The long expressions depend on the patterns alone and name no table, so they are built once.


@functools.cache
def _whole(by_file: tuple[Pattern, ...], replacement: str) -> Column:
    """The content with the secrets of file patterns replaced."""
    content = F.col("content")
    return F.when(F.expr(prefilter.file_condition("content", by_file)),
                  _redact(content, by_file, replacement)).otherwise(content)


@functools.cache
def _joined(by_line: tuple[Pattern, ...], replacement: str) -> Column:
    """The pieces with the secrets of line patterns replaced, as one text."""
    hinted = prefilter.condition("p", prefilter.hinted(by_line))
    flags = F.expr(f"transform(_pieces, p -> {hinted})")

    def rewrite(piece: Column, flag: Column) -> Column:
        for pattern in prefilter.unhinted(by_line):
            flag = flag | piece.rlike(pattern.regex)
        return F.when(flag, _redact(piece, by_line, replacement)).otherwise(piece)

    return F.array_join(F.zip_with("_pieces", flags, rewrite), "")


def redact(
    files: DataFrame,
    custom: Iterable[Pattern] = (),
    builtin: Iterable[Pattern] = PATTERNS,
    replacement: str = REPLACEMENT,
) -> DataFrame:
    """Files with ``content`` redacted and ``is_redacted`` set where it changed.

    File patterns act on the whole text.  Line patterns act line by line, as in
    detection: the text is cut behind each line end, lines that may match are
    rewritten, and the pieces are joined again.  All patterns look at the text as it is, not at what
    another one left, so their order has no effect.  Markers are no secrets and stay.
    """
    patterns = [p for p in (*builtin, *custom) if not p.marker]
    by_line = tuple(p for p in patterns if p.scope == "line")
    by_file = tuple(p for p in patterns if p.scope == "file")
    staged = files.withColumn("_whole", _whole(by_file, replacement) if by_file else F.col("content"))
    text = F.col("_whole")
    if by_line:
        staged = staged.withColumn("_pieces", F.when(
            F.expr(prefilter.file_condition("_whole", by_line)),
            F.split("_whole", r"(?<=\n)|(?<=\r)(?!\n)")))
        text = F.coalesce(_joined(by_line, replacement), text)
    return (
        staged.withColumn("_text", text)
        .withColumn("is_redacted", ~F.col("_text").eqNullSafe(F.col("content")))
        .withColumn("content", F.col("_text"))
        .drop("_whole", "_pieces", "_text")
    )
