"""Cheap conditions that hold wherever a pattern can match.

A condition may let text through that no pattern matches; it never holds back
text that one does.  Conditions are SQL text over the name of a string column:
they are long but simple, and Spark parses one of them much faster than it can
be told the same column by column.  User regexes are never pasted into SQL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.catalog import Pattern


_MARKS = "_-/\""


def _literal(fragment: str) -> str:
    """Fragments hold no quote and no backslash (``catalog`` checks), so none is escaped."""
    return f"'{fragment}'"


def _contains(text: str, fragment: str) -> str:
    return f"contains({text}, {_literal(fragment)})"


def _ignoring_case(text: str, fragments: Iterable[str]) -> str:
    """One look at the text for all fragments; the leading class rejects most positions."""
    fragments = sorted(set(fragments))
    first = "".join(sorted({f[0] for f in fragments}))
    wanted = "|".join(fragments)
    regex = _literal(f"(?i)(?=[{first}])(?:{wanted})")
    return f"(({_contains(text, '=')} OR {_contains(text, ':')}) AND {text} RLIKE {regex})"


def _shortest(fragments: set[str]) -> list[str]:
    """Without fragments that contain another one of the set."""
    return sorted(f for f in fragments if not any(o != f and o in f for o in fragments))


def _contains_any(text: str, fragments: set[str]) -> list[str]:
    """One condition per fragment, grouped behind a punctuation mark they share.

    Text without the mark (prose has no ``_``) is spared the whole group, and
    text with it pays almost nothing, since the search ends at the first one.
    """
    parts, left = [], _shortest(fragments)
    for mark in _MARKS:
        group = [f for f in left if mark in f]
        if len(group) > 1:
            left = [f for f in left if f not in group]
            either = " OR ".join(_contains(text, f) for f in group)
            parts.append(f"({_contains(text, mark)} AND ({either}))")
    return parts + [_contains(text, f) for f in left]


def hinted(patterns: Iterable[Pattern]) -> list[Pattern]:
    return [p for p in patterns if p.hints or p.shape]


def unhinted(patterns: Iterable[Pattern]) -> list[Pattern]:
    return [p for p in patterns if not p.hints and not p.shape]


def condition(text: str, patterns: Iterable[Pattern]) -> str:
    """SQL: one of the patterns, all of them with hints or a shape, may match ``text``."""
    patterns = list(patterns)
    plain = {h for p in patterns if not p.ignore_case for h in p.hints}
    folded = {h for p in patterns if p.ignore_case for h in p.hints}
    parts = _contains_any(text, plain)
    if folded:
        parts.append(_ignoring_case(text, folded))
    parts += [f"{text} RLIKE {_literal(p.shape)}" for p in patterns if p.shape]
    return "(" + " OR ".join(parts or ["false"]) + ")"


def file_condition(content: str, patterns: Iterable[Pattern]) -> str:
    """SQL: some line of a file may match.

    A regex without hints may use anchors that mean something else on a whole
    file than on a line, so it switches this condition off.
    """
    patterns = list(patterns)
    return "true" if unhinted(patterns) else condition(content, patterns)


def line_may_match(text: str, patterns: Iterable[Pattern]) -> Column:
    """Any of the patterns may match the line in column ``text``."""
    patterns = list(patterns)
    result = F.expr(condition(text, hinted(patterns)))
    for pattern in unhinted(patterns):
        result = result | F.col(text).rlike(pattern.regex)
    return result
