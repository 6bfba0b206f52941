"""User patterns from JSON, checked before use."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift import schemas
from keysift.catalog import Pattern, custom_pattern, literal_hints
from keysift.functions.ambiguity import Verdict, judge

# Limits on user patterns.
MAX_PATTERNS = 100
MAX_PATTERN_LENGTH = 500


def repeats_inside_repeat(regex: str) -> bool:
    """Whether a repeated group holds a repetition or a choice, at any depth, as in ((a+))+ or (a|a)*."""
    held, closed, i, in_class = [False], False, 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i, closed = i + 2, False
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class, closed = True, False
            i += regex[i + 1:i + 2] == "]"
        elif c == "(":
            held.append(False)
            closed = False
            i += regex[i + 1:i + 2] == "?"
        elif c == ")" and len(held) > 1:
            inner = held.pop()
            held[-1] |= inner
            closed = inner
            i += 1
            continue
        elif c in "*+" or c == "{" and regex[i + 1:i + 2].isdigit():
            if closed:
                return True
            held[-1] = True
        elif c == "|":
            held[-1] = True
        if c not in "?":
            closed = False
        i += 1
    return False


def read_custom_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, regex, description) of ``{"patterns": [...]}``, those without regex dropped."""
    raw = spark.read.schema(schemas.CUSTOM_PATTERNS).json(path, multiLine=True)
    rows = raw.select(F.inline("patterns"))
    return rows.where(F.coalesce(F.col("regex"), F.lit("")) != "").select(
        F.coalesce("name", F.lit("CUSTOM_PATTERN")).alias("name"), "regex",
        F.coalesce("description", F.lit("")).alias("description"),
    )


def verdict(spark: SparkSession, regex: str) -> Verdict:
    """Whether a pattern can be used: the engine compiles it and cannot be made to take for ever.

    Nothing is run; the engine's own compiler and the regex's automaton decide.
    """
    if len(regex) > MAX_PATTERN_LENGTH:
        return Verdict(False, "too large", None, "too long")
    try:
        spark._jvm.java.util.regex.Pattern.compile(regex)
    except IllegalArgumentException:
        return Verdict(False, "unreadable", None, "does not compile")
    found = judge(regex)
    if found.kind == "exponential" and repeats_inside_repeat(regex):
        return replace(found, reason="nested quantifiers")
    return found


class RefusedPatterns(ValueError):
    """A file of user patterns that cannot be used as it is; ``reasons`` by pattern."""

    def __init__(self, path: str, reasons: dict[str, str]) -> None:
        self.reasons = reasons
        super().__init__(f"{path}: " + "; ".join(f"{k}: {v}" for k, v in reasons.items()))


def load_custom_patterns(spark: SparkSession, path: str, strict: bool = True) -> list[Pattern]:
    """The patterns of a file.

    A refused entry, more than ``MAX_PATTERNS`` entries or a file without any raise
    ``RefusedPatterns``, so no pattern is left out unseen; without ``strict`` the accepted ones are
    returned.
    """
    rows = read_custom_patterns(spark, path).take(MAX_PATTERNS + 1)
    if not rows or len(rows) > MAX_PATTERNS:
        raise RefusedPatterns(path, {"file": f"more than {MAX_PATTERNS} patterns" if rows else
                                     "no pattern found"})
    reasons = [verdict(spark, r["regex"]).reason for r in rows]
    refused = {f"{n}. {r['name']}": why for n, (r, why) in enumerate(zip(rows, reasons), 1) if why}
    if refused and strict:
        raise RefusedPatterns(path, refused)
    return [custom_pattern(r["name"], r["regex"], r["description"], hints=literal_hints(r["regex"]))
            for r, why in zip(rows, reasons) if why is None]
