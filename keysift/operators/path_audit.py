"""File names a scan should refuse or report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions.paths import policy_flags


def audit_paths(listing: DataFrame) -> DataFrame:
    """Adds one boolean per rule and ``is_violation``."""
    flags = policy_flags(F.col("path"))
    flagged = listing.select("*", *[c.alias(n) for n, c in flags.items()])
    return flagged.withColumn("is_violation", F.array_contains(F.array(*flags), True))
