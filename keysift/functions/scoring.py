"""Entropy, context and risk of a match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.options import ScanOptions


def shannon_entropy(text: Column) -> Column:
    """Bits per character, 0.0 for empty text, rounded to four digits.

    With n characters, c of them alike: log2(n) - sum(c * log2(c)) / n.  Sorting
    the characters puts equal ones side by side, so one regex pass counts them.
    """
    size = F.length(text)
    alike = F.regexp_extract_all(
        F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    weighted = F.aggregate(
        alike, F.lit(0.0), lambda total, run: total + F.length(run) * F.log2(F.length(run)))
    # Adding zero turns a negative zero into zero.
    bits = F.round(F.log2(size) - weighted / size, 4) + F.lit(0.0)
    return F.when(size == 0, F.lit(0.0)).otherwise(bits)


def is_high_entropy(entropy: Column, options: ScanOptions) -> Column:
    return entropy > options.high_entropy


def is_context_path(path: Column, options: ScanOptions) -> Column:
    """A directory or file of the path is named like tests, docs or examples."""
    names = "|".join(options.context_dirs)
    return F.lower(path).rlike(f"(^|/)({names})(/|$)")


def is_denylisted(secret: Column, options: ScanOptions) -> Column:
    """The secret holds a word that only made-up values hold."""
    if not options.denylist:
        return F.lit(False)
    return F.lower(secret).rlike("|".join(re.escape(word) for word in options.denylist))


def risk_score(
    base: Column, entropy: Column, context_path: Column, denylisted: Column, options: ScanOptions
) -> Column:
    """0 to 100.  All terms are added first and clamped once, so their order is irrelevant."""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    total = (
        base
        + points(is_high_entropy(entropy, options), options.high_entropy_bonus)
        - points(entropy < options.low_entropy, options.low_entropy_penalty)
        - points(context_path, options.test_path_penalty)
        - points(denylisted, options.denylist_penalty)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def risk_level(score: Column, options: ScanOptions) -> Column:
    return (
        F.when(score >= options.high_risk_from, "high")
        .when(score >= options.medium_risk_from, "medium")
        .otherwise("low")
    )


def classification(score: Column, options: ScanOptions) -> Column:
    return (
        F.when(score >= options.high_risk_from, "likely_secret")
        .when(score >= options.medium_risk_from, "possible_secret")
        .otherwise("likely_false_positive")
    )


def match_preview(secret: Column) -> Column:
    """The first four characters; short secrets are hidden whole."""
    shown = F.concat(F.substring(secret, 1, 4), F.lit("..."))
    return F.when(F.length(secret) < 8, F.lit("***")).otherwise(shown)


def secret_hash(secret: Column, marker: Column, repo: Column, path: Column) -> Column:
    """SHA-256 of the secret.

    A marker (text that is the same in every file) is hashed with its place, so
    that two files holding it stay two findings.
    """
    placed = F.concat_ws("\n", secret, repo, path)
    return F.sha2(F.when(marker, placed).otherwise(secret), 256)
