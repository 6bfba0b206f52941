"""Where secrets stand in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.catalog import Pattern


def secret_spans(text: Column, pattern: Pattern, whole: bool = False) -> Column:
    """(s, e) of every secret of a pattern, in characters from 0; the end is exclusive.

    ``whole`` adds ``l``, the line that the match begins on, from 1, and ``secret``.

    A text is what lies between the matches and the matches in turn, so running lengths give the
    places.  Each match is its lead, the secret and its tail.
    """
    def groups(n: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern.redaction_regex), F.lit(n))

    columns = [F.split(text, pattern.redaction_regex, -1).alias("between"), groups(0).alias("match")]
    if pattern.group:
        columns += [groups(1).alias("lead"), groups(2).alias("tail")]
    turns = F.arrays_zip(*columns)
    none = F.array().cast(f"array<struct<s:int,e:int{',l:int,secret:string' if whole else ''}>>")

    def ends(part: Column) -> Column:
        return F.size(F.split(part, "\r\n|\r|\n", -1)) - 1

    def add(seen: Column, turn: Column) -> Column:
        at = seen["at"] + F.length(turn["between"])
        start, end = at, at + F.length(turn["match"])
        after = end
        if pattern.group:
            start, end = at + F.length(turn["lead"]), end - F.length(turn["tail"])
        span = [start.alias("s"), end.alias("e")]
        lines = []
        if whole:
            line = seen["line"] + ends(turn["between"])
            secret = F.substring(turn["match"], start - at + 1, end - start)
            span += [line.alias("l"), secret.alias("secret")]
            lines = [(line + ends(turn["match"])).alias("line")]
        return F.when(turn["match"].isNull(), seen).otherwise(F.struct(
            after.alias("at"), F.concat(seen["spans"], F.array(F.struct(*span))).alias("spans"), *lines))

    found = F.aggregate(turns, F.struct(
        F.lit(0).alias("at"), none.alias("spans"),
        *([F.lit(1).alias("line")] if whole else [])), add,
                        lambda seen: seen["spans"])
    return F.when(text.rlike(pattern.regex), found).otherwise(none)
