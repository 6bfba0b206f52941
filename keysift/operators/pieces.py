"""Matches in files that come in overlapping pieces (``sources.tree.read_pieces``).

Every piece is matched with its overlap, and a match belongs to the piece in whose own part its secret
begins, so a match across a border is found whole and counted once.  The result is that of the
whole text as long as no match, and no run of matches without a gap, is longer than the overlap.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.catalog import PATTERNS, Pattern
from keysift.functions import prefilter
from keysift.functions.spans import secret_spans
from keysift.operators.findings import assess
from keysift.operators.lines import split_lines_sql
from keysift.options import ScanOptions

_BASE = ("repo", "path", "first_line", "first_char", "low", "low_line", "low_char")


def _found(text: Column, patterns: tuple[Pattern, ...]) -> Column:
    """(p, s, l, secret) of all secrets of all patterns in a text."""
    def spans(number: int, pattern: Pattern) -> Column:
        return F.transform(secret_spans(text, pattern, whole=True), lambda x: F.struct(
            F.lit(number).alias("p"), x["s"].alias("s"), x["l"].alias("l"), x["secret"].alias("secret")))

    # The outer form spares a check of the array's size that would make it twice.
    return F.explode_outer(F.flatten(F.array(*[spans(n, p) for n, p in enumerate(patterns)])))


def _attributes(rows: DataFrame, patterns: tuple[Pattern, ...]) -> DataFrame:
    def of(values: Iterable[str]) -> Column:
        return F.get(F.split(F.lit("\x1f".join(values)), "\x1f"), F.col("m.p"))

    return rows.select(
        "repo", "path", "line", "char", of(p.name for p in patterns).alias("pattern"),
        of(p.severity for p in patterns).alias("severity"),
        of(str(p.marker) for p in patterns).cast("boolean").alias("marker"), "m.secret")


def _order() -> Column:
    """Orders the matches of a line, or of a file: by piece, and by place in it."""
    return F.struct(F.col("first_char"), F.col("m.s"))


def _by_line(pieces: DataFrame, patterns: tuple[Pattern, ...]) -> DataFrame:
    """Matches of line patterns that begin in a piece's own part."""
    rows = pieces.where(F.expr(prefilter.file_condition("content", patterns)))
    lines = rows.select(*_BASE, "high_line", "high_char", F.posexplode_outer(
        F.expr(split_lines_sql("content"))).alias("at", "text"))
    lines = lines.where(F.col("at").between(F.col("low_line"), F.col("high_line")))
    tried = lines.where(prefilter.line_may_match("text", patterns))
    found = tried.select(*_BASE, "high_line", "high_char", "at", _found(
        F.col("text"), patterns).alias("m")).where("m IS NOT NULL")
    begins = (F.col("at") > F.col("low_line")) | (F.col("m.s") >= F.col("low_char"))
    ends = (F.col("at") < F.col("high_line")) | (F.col("m.s") < F.col("high_char"))
    return _attributes(found.where(begins & ends).select(
        "repo", "path", (F.col("first_line") + F.col("at") - F.col("low_line") + 1).cast("int").alias(
            "line"),
        _order().alias("char"), "m"), patterns)


def _by_file(pieces: DataFrame, patterns: tuple[Pattern, ...]) -> DataFrame:
    rows = pieces.where(F.expr(prefilter.file_condition("content", patterns)))
    found = rows.select(*_BASE, "high", _found(F.col("content"), patterns).alias("m")).where(
        (F.col("m.s") >= F.col("low")) & (F.col("m.s") < F.col("high")))
    # In whole files, line ends count as one character.
    plain = F.col("m").withField("secret", F.regexp_replace("m.secret", "\r\n|\r", "\n"))
    found = found.withColumn("m", plain)
    return _attributes(found.select(
        "repo", "path", (F.col("first_line") + F.col("m.l") - F.col("low_line")).cast("int").alias("line"),
        _order().alias("char"), "m"), patterns)


def detect_in_pieces(
    pieces: DataFrame, options: ScanOptions | None = None, custom: Iterable[Pattern] = (),
    builtin: Iterable[Pattern] = PATTERNS,
) -> DataFrame:
    """The findings of ``plans.scan.detect`` for files in pieces.

    Matching moves no row.  Occurrences are numbered over all pieces of a line (of a file, for
    patterns over several lines) afterwards, when the raw secret is gone.
    """
    given = [*builtin, *custom]
    by_line = tuple(p for p in given if p.scope == "line")
    by_file = tuple(p for p in given if p.scope == "file")
    parts = [make(pieces, of) for make, of in ((_by_line, by_line), (_by_file, by_file)) if of]
    if not parts:
        raise ValueError("no patterns given")
    matches = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = assess(matches.withColumn("occurrence", F.col("char")), options or ScanOptions())
    files = [p.name for p in by_file]
    line = F.when(F.col("pattern").isin(files), 0).otherwise(F.col("line")) if files else F.col("line")
    order = Window.partitionBy("repo", "path", "pattern", line).orderBy("occurrence")
    return found.withColumn("occurrence", F.row_number().over(order))
