"""Every match of every pattern, in one pass over the files.

A file becomes a short list of texts: the whole content if a file pattern may
match it, and its numbered lines if a line pattern may.  Two cheap conditions
(``functions.prefilter``) drop files and then lines that cannot match; what is
left is tried with the patterns that may match it.  The patterns are literals of
one projection, so each regex is compiled once per task.  No row moves between
tasks, and the input is read once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.catalog import PATTERNS, Pattern
from keysift.functions import prefilter
from keysift.operators.lines import split_lines_sql


def _texts(by_line: Sequence[Pattern], by_file: Sequence[Pattern], use_prefilter: bool) -> Column:
    """Element 0 is the content for file patterns or null; element n is line n.

    The content may be a costly expression (unescaped, decoded), so it is named
    by a one-element ``transform`` and evaluated once.
    """
    whole = numbered = "true"
    if use_prefilter:
        whole = prefilter.file_condition("c", by_file) if by_file else "false"
        numbered = prefilter.file_condition("c", by_line) if by_line else "false"
    return F.expr(f"""
        get(transform(array(content), c -> concat(
            array(CASE WHEN {whole} THEN c END),
            coalesce(CASE WHEN {numbered} THEN {split_lines_sql('c')} END,
                     cast(array() AS array<string>)))), 0)
    """)


def _secrets(text: Column, pattern: Pattern, group: int | None = None) -> Column:
    wanted = pattern.group if group is None else group
    return F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(wanted))


def _start_lines(content: Column, pattern: Pattern) -> Column:
    """The line each match of a file pattern starts on.

    A control character is put before every match; each line then gives its
    number once per such character.  The work is linear in the size of the file.
    """
    mark = "\x01"
    clean = F.replace(content, F.lit(mark), F.lit("\x02"))
    marked = F.regexp_replace(clean, F.lit(pattern.regex), F.lit(mark + "$0"))

    def repeated(line: Column, index: Column) -> Column:
        return F.array_repeat(index + 1, F.length(line) - F.length(F.replace(line, F.lit(mark))))

    return F.flatten(F.transform(F.split(marked, "\n"), repeated))


def _applies(pattern: Pattern, use_prefilter: bool) -> Column:
    scope = "line > 0" if pattern.scope == "line" else "line = 0"
    if use_prefilter and prefilter.hinted([pattern]):
        scope += " AND " + prefilter.condition("text", [pattern])
    return F.expr(scope)


def _file_text() -> Column:
    text = F.col("text")
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n|\r", "\n")).otherwise(text)


# The long expressions depend on the patterns alone and name no table, so a
# session that scans many inputs (or batches of a stream) builds them once.


@functools.cache
def _attempts(patterns: tuple[Pattern, ...], use_prefilter: bool) -> Column:
    """One array of secrets per pattern, null where the pattern does not apply."""
    found = []
    for p in patterns:
        text = F.col("text") if p.scope == "line" else _file_text()
        found.append(F.when(_applies(p, use_prefilter), _secrets(text, p)))
    return F.array(*found)


@functools.cache
def _starts(by_file: tuple[Pattern, ...], use_prefilter: bool) -> Column:
    """One array of start lines per file pattern."""
    return F.array(*[
        F.when(_applies(p, use_prefilter), _start_lines(_file_text(), p)) for p in by_file
    ]).cast("array<array<int>>")


def _attribute(values: Iterable[str]) -> Column:
    """The value of pattern number ``p``, from one constant."""
    return F.get(F.split(F.lit("\x1f".join(values)), "\x1f"), F.col("m.p"))


def find_matches(
    files: DataFrame,
    custom: Iterable[Pattern] = (),
    builtin: Iterable[Pattern] = PATTERNS,
    use_prefilter: bool = True,
) -> DataFrame:
    """All matches of built-in and user patterns.  ``secret`` is raw: do not store this table.

    ``use_prefilter=False`` tries every pattern on every text; the result is the same.
    """
    given = [*builtin, *custom]
    if not given:
        raise ValueError("no patterns given")
    by_file = tuple(p for p in given if p.scope == "file")
    by_line = tuple(p for p in given if p.scope == "line")
    patterns = by_file + by_line

    texts = _texts(by_line, by_file, use_prefilter)
    tried = files.select("repo", "path", F.posexplode_outer(texts).alias("line", "text"))
    tried = tried.where(F.col("text").isNotNull())
    if use_prefilter:
        tried = tried.where((F.col("line") == 0) | prefilter.line_may_match("text", by_line))
    # File patterns come first, so their start lines sit at their own number.
    matched = F.expr("""
        filter(transform(found, (s, p) -> struct(p, s AS secrets, get(starts, p) AS starts)),
               m -> size(m.secrets) > 0)
    """)
    return tried.select(
        "repo", "path", "line",
        _attempts(patterns, use_prefilter).alias("found"),
        _starts(by_file, use_prefilter).alias("starts"),
    ).select(
        "repo", "path", "line", F.explode_outer(matched).alias("m")
    ).where(F.col("m").isNotNull()).select(
        "repo", "path", "line",
        _attribute(p.name for p in patterns).alias("pattern"),
        _attribute(p.severity for p in patterns).alias("severity"),
        _attribute(str(p.marker) for p in patterns).cast("boolean").alias("marker"),
        "m.starts", F.posexplode_outer("m.secrets").alias("pos", "secret"),
    ).select(
        "repo", "path", F.coalesce(F.get("starts", F.col("pos")), F.col("line")).alias("line"),
        "pattern", (F.col("pos") + 1).alias("occurrence"), "severity", "marker", "secret",
    )
