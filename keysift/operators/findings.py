"""Matches to findings: entropy, context, score, level, preview and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions import scoring
from keysift.options import ScanOptions
from keysift.session import join_keys


def _base_score(severity: Column, options: ScanOptions) -> Column:
    first, *rest = options.base_scores.items()
    points = F.when(severity == first[0], F.lit(first[1]))
    for name, value in rest:
        points = points.when(severity == name, F.lit(value))
    return points.otherwise(F.lit(0))


def assess(matches: DataFrame, options: ScanOptions, known_fakes: DataFrame | None = None
           ) -> DataFrame:
    """Findings.  The raw secret is gone after this projection.

    ``known_fakes`` (column ``secret``, lower case) extends the word list of the
    options by whole values and may be large.
    """
    secret = F.col("secret")
    rows = matches.withColumns({
        "entropy": scoring.shannon_entropy(secret),
        "is_test_path": scoring.is_context_path(F.col("path"), options),
        "is_denylisted": scoring.is_denylisted(secret, options),
        "match_preview": scoring.match_preview(secret),
        "secret_hash": scoring.secret_hash(
            secret, F.col("marker"), F.col("repo"), F.col("path")),
    })
    if known_fakes is not None:
        rows = _flag_known_fakes(rows, known_fakes)
    rows = rows.withColumn("score", scoring.risk_score(
        _base_score(F.col("severity"), options), F.col("entropy"),
        F.col("is_test_path"), F.col("is_denylisted"), options))
    return rows.select(
        "repo", "path", "line", "pattern", "occurrence", "severity", "score",
        scoring.classification(F.col("score"), options).alias("classification"),
        scoring.risk_level(F.col("score"), options).alias("risk_level"),
        "entropy", "match_preview", "secret_hash", "is_test_path", "is_denylisted",
    )


def _flag_known_fakes(matches: DataFrame, known_fakes: DataFrame) -> DataFrame:
    """A left join on the hash of the folded value, so no raw secret is shuffled."""
    fakes = known_fakes.select(F.sha2("secret", 256).alias("_folded")).distinct().withColumn(
        "_known", F.lit(True))
    flagged = join_keys(
        matches.withColumn("_folded", F.sha2(F.lower("secret"), 256)), fakes, "_folded", "left",
        spread_by=["repo", "path", "line"])
    return flagged.withColumn(
        "is_denylisted", F.col("is_denylisted") | F.coalesce("_known", F.lit(False))
    ).drop("_folded", "_known")
