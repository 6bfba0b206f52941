"""Guidance for findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift import schemas
from keysift.remediation import DEFAULT_TEMPLATE, templates


def remediation_table(spark: SparkSession) -> DataFrame:
    """One row per catalogue pattern."""
    return spark.createDataFrame(templates(), schemas.REMEDIATION)


def _template(immediate_actions: Iterable[str], prevention: Iterable[str], rotation_command: str,
              docs_url: str) -> Column:
    return F.struct(
        F.array(*[F.lit(a) for a in immediate_actions]).alias("immediate_actions"),
        F.array(*[F.lit(p) for p in prevention]).alias("prevention"),
        F.lit(rotation_command).alias("rotation_command"),
        F.lit(docs_url).alias("docs_url"),
    )


def remediation() -> Column:
    """The advice of a finding, from one constant: a projection, so it can follow a sort.

    Unknown patterns get the default advice; the severity is the finding's own.
    """
    known = F.create_map(*[x for name, _, *rest in templates()
                           for x in (F.lit(name), _template(*rest))])
    default = DEFAULT_TEMPLATE
    template = F.coalesce(known[F.col("pattern")], _template(
        default.immediate_actions, default.prevention, default.rotation_command, default.docs_url))
    return F.struct(
        F.col("severity").alias("severity"),
        *[template[c].alias(c) for c in ("immediate_actions", "prevention", "rotation_command",
                                         "docs_url")])


def with_remediation(findings: DataFrame) -> DataFrame:
    """Adds ``remediation``; unknown patterns get the default advice and their own severity.

    The table has one row per built-in pattern, a fixed size, so it is broadcast.
    """
    advice = remediation_table(findings.sparkSession).select(
        "pattern",
        F.struct("immediate_actions", "prevention", "rotation_command", "docs_url").alias("_t"),
    )
    default = F.struct(
        F.array(*[F.lit(a) for a in DEFAULT_TEMPLATE.immediate_actions]).alias("immediate_actions"),
        F.array(*[F.lit(p) for p in DEFAULT_TEMPLATE.prevention]).alias("prevention"),
        F.lit(DEFAULT_TEMPLATE.rotation_command).alias("rotation_command"),
        F.lit(DEFAULT_TEMPLATE.docs_url).alias("docs_url"),
    )
    joined = findings.join(F.broadcast(advice), "pattern", "left")
    template = F.coalesce("_t", default)
    return joined.withColumn(
        "remediation",
        F.struct(
            F.col("severity").alias("severity"),
            template["immediate_actions"].alias("immediate_actions"),
            template["prevention"].alias("prevention"),
            template["rotation_command"].alias("rotation_command"),
            template["docs_url"].alias("docs_url"),
        ),
    ).select(*findings.columns, "remediation")
