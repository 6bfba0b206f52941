"""JSON, CSV and SARIF reports of findings."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.catalog import PATTERNS
from keysift.operators.dedup import report_order
from keysift.operators.remediate import remediation, with_remediation
from keysift.operators.summary import pattern_summary, risk_summary
from keysift.options import ScanOptions
from keysift.session import join_files, materialize, new_scratch

# The CSV columns in order.
CSV_COLUMNS = (
    "severity", "score", "classification", "pattern", "repo", "path", "line", "entropy",
    "remediation_summary", "rotation_command", "docs_url",
)
FORMATS = ("json", "csv", "sarif")
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
# SARIF level by risk level.
SARIF_LEVELS = {"high": "error", "medium": "warning", "low": "note"}

# Results in one SARIF log; a repository with more has several.
SARIF_RESULTS = 5_000


def finding_json(findings: DataFrame) -> Column:
    """One finding with its remediation as a JSON object."""
    optional = [c for c in ("git_blame",) if c in findings.columns]
    return F.to_json(F.struct(
        "repo", "path", "line", "pattern", "score", "classification", "risk_level", "entropy",
        "match_preview", "secret_hash", "is_test_path", "is_denylisted", "remediation", *optional,
    ))


def csv_rows(remediated: DataFrame) -> DataFrame:
    """The flat report; the summary is the first immediate action."""
    advice = F.col("remediation")
    return remediated.select(
        "severity", "score", "classification", "pattern", "repo", "path", "line", "entropy",
        F.get(advice["immediate_actions"], F.lit(0)).alias("remediation_summary"),
        advice["rotation_command"].alias("rotation_command"),
        advice["docs_url"].alias("docs_url"),
    )


def sarif_level(risk_level: Column) -> Column:
    return (
        F.when(risk_level == "high", SARIF_LEVELS["high"])
        .when(risk_level == "medium", SARIF_LEVELS["medium"])
        .otherwise(SARIF_LEVELS["low"])
    )


def sarif_rules(remediated: DataFrame, described: Mapping[str, str] | None = None) -> DataFrame:
    """(rule_id, description, help_uri, severity), one row per pattern that was found.

    ``described`` holds the patterns' own descriptions; the others get a general one.
    """
    general = F.concat(F.lit("Possible "), F.col("pattern"), F.lit(" in source"))
    named = [F.lit(x) for kv in (described or {}).items() if kv[1] for x in kv]
    own = F.create_map(*named)[F.col("pattern")] if named else F.lit(None).cast("string")
    return remediated.groupBy(F.col("pattern").alias("rule_id")).agg(
        F.max(F.coalesce(own, general)).alias("description"),
        F.max("remediation.docs_url").alias("help_uri"),
        F.max("severity").alias("severity"),
    )


def relative_uri(path: Column) -> Column:
    """A path as a URI reference: every part is escaped, the slashes stay."""
    escaped = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    return F.replace(escaped, F.lit("%2F"), F.lit("/"))


def sarif_result(place: Column | None = None) -> Column:
    """One finding as a SARIF result at its path or ``place``; the fingerprint is the hash, never the
    secret."""
    place = F.col("path") if place is None else place
    message = F.concat(
        F.col("pattern"), F.lit(" ("), F.col("classification"), F.lit(", score "),
        F.col("score").cast("string"), F.lit(")"),
    )
    location = F.struct(F.struct(
        F.struct(relative_uri(place).alias("uri")).alias("artifactLocation"),
        F.struct(F.col("line").alias("startLine")).alias("region"),
    ).alias("physicalLocation"))
    return F.to_json(F.struct(
        F.col("pattern").alias("ruleId"),
        sarif_level(F.col("risk_level")).alias("level"),
        F.struct(message.alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct(F.col("secret_hash").alias("secretHash")).alias("partialFingerprints"),
    ))


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def report_summary(findings: DataFrame) -> dict:
    """Counts for the report head: one row of levels and one row per pattern."""
    risk = risk_summary(findings).first()
    counts = pattern_summary(findings).collect()
    by_pattern = {r["pattern"]: r["n_findings"] for r in counts}
    return {
        "total_findings": risk["total_findings"],
        "by_risk_level": {k: risk[k] for k in ("high_risk", "medium_risk", "low_risk")},
        "by_pattern": dict(sorted(by_pattern.items(), key=lambda kv: (-kv[1], kv[0]))),
    }


def _sorted(stored: DataFrame) -> DataFrame:
    """Findings in report order; their advice is added behind the sort and not shuffled."""
    return stored.orderBy(*report_order()).withColumn("remediation", remediation())


def report_head(summary: dict, options: ScanOptions, timestamp: str | None = None) -> dict:
    return {
        "scan_metadata": {
            "timestamp": timestamp or _now(),
            "organization": options.organization,
            "total_findings": summary["total_findings"],
            "scanner_version": options.scanner_version,
        },
        "summary": {k: summary[k] for k in ("by_risk_level", "by_pattern")},
    }


def write_json_report(
    stored: DataFrame, path: str, summary_path: str, options: ScanOptions, summary: dict,
    timestamp: str | None = None,
) -> None:
    """Sorted findings as JSON Lines, and one object with metadata and summary beside them."""
    head = report_head(summary, options, timestamp)
    ordered = _sorted(stored)
    ordered.select(finding_json(ordered).alias("value")).write.text(path)
    stored.sparkSession.createDataFrame([(json.dumps(head),)], "value STRING").coalesce(
        1).write.text(summary_path)


def write_csv_report(stored: DataFrame, path: str) -> None:
    """Sorted parts, each with the head line."""
    csv_rows(_sorted(stored)).write.option("escape", '"').csv(path, header=True)


def _rules(stored: DataFrame, described: Mapping[str, str] | None) -> dict[str, dict]:
    """The rules of a SARIF log by pattern, in order."""
    names = {p.name: p.description for p in PATTERNS} | dict(described or {})
    found = sarif_rules(with_remediation(stored), names).collect()  # a row for each pattern
    return {r["rule_id"]: {"id": r["rule_id"], "shortDescription": {"text": r["description"]},
                           "helpUri": r["help_uri"]}
            for r in sorted(found, key=lambda r: r["rule_id"])}


def write_sarif_report(
    stored: DataFrame, path: str, options: ScanOptions, described: Mapping[str, str] | None = None,
) -> None:
    """SARIF logs, one per line, in a folder for each repository; paths are relative to it.

    Findings are sorted over the cluster and cut where the repository changes or a log is full,
    so no task holds all findings of a large repository.
    """
    rules = _rules(stored, described)
    rule = F.create_map(*[F.lit(x) for name, text in rules.items() for x in (name, json.dumps(text))]
                        ) if rules else F.lit(None).cast("map<string,string>")
    number = F.monotonically_increasing_id()
    ordered = stored.orderBy("repo", *report_order()).select(
        "repo", "pattern", sarif_result().alias("result"), number.alias("n"))
    ordered = ordered.withColumn("log", F.floor(F.col("n") / SARIF_RESULTS))
    logs = ordered.groupBy("repo", "log").agg(
        F.array_sort(F.collect_list(F.struct("n", "result"))).alias("results"),
        F.array_sort(F.collect_set("pattern")).alias("patterns"))
    driver = json.dumps({"name": "keysift", "version": options.scanner_version})[:-1]
    value = F.concat(
        F.lit(f'{{"version": "{SARIF_VERSION}", "$schema": "{SARIF_SCHEMA}", "runs": [{{"tool": '
              f'{{"driver": {driver}, "rules": ['),
        F.array_join(F.transform("patterns", lambda p: rule[p]), ", "),
        F.lit(']}}, "results": ['), F.array_join("results.result", ", "), F.lit("]}]}"))
    logs.select("repo", value.alias("value")).write.partitionBy("repo").text(path)


def write_documents(
    findings: DataFrame,
    out_dir: str,
    options: ScanOptions | None = None,
    formats: Iterable[str] = FORMATS,
    timestamp: str | None = None,
    described: Mapping[str, str] | None = None,
) -> dict:
    """Write each wanted format as one file, ``report.json``, ``.csv`` or ``.sarif``; returns the summary.

    One JSON object with all findings, one table with one head line, one SARIF log with one run whose
    paths begin with the repository.  The findings are sorted once for all formats and written in
    ordered parts by the tasks; the parts are then joined byte by byte between head and tail, so
    neither a task nor the driver holds all findings.  A file appears whole or not at all.  For
    very many findings the parts of ``write_reports`` are read and written faster.
    """
    options = options or ScanOptions()
    formats = _known(formats)
    spark = findings.sparkSession
    stored = materialize(findings, "findings")
    summary = report_summary(stored)
    ordered = stored.orderBy(*report_order()).select(
        "*", F.monotonically_increasing_id().alias("n"), remediation().alias("remediation"))
    flat = csv_rows(ordered).columns
    advice = F.col("remediation")
    row = F.struct(*[
        F.get(advice["immediate_actions"], F.lit(0)).alias(c) if c == "remediation_summary"
        else advice[c].alias(c) if c in ("rotation_command", "docs_url") else F.col(c) for c in flat])
    lines = {
        "json": F.concat(F.lit(","), finding_json(ordered)),
        "csv": F.to_csv(row, {"escape": '"'}),
        "sarif": F.concat(F.lit(","), sarif_result(F.concat_ws("/", "repo", "path"))),
    }
    parts = new_scratch(spark, "lines")
    ordered.select("n", F.explode(F.array(*[
        F.struct(F.lit(f).alias("format"), lines[f].alias("value")) for f in formats])).alias("line")
    ).select("line.format", "n", "line.value").sortWithinPartitions("format", "n").select(
        "format", "value").write.partitionBy("format").text(parts)
    run = {"tool": {"driver": {"name": "keysift", "version": options.scanner_version,
                               "rules": list(_rules(stored, described).values())}}}
    log = {"version": SARIF_VERSION, "$schema": SARIF_SCHEMA}
    ends = {
        "json": (json.dumps(report_head(summary, options, timestamp))[:-1] + ', "findings": [\n', "]}\n"),
        "csv": (",".join(CSV_COLUMNS) + "\n", ""),
        "sarif": (json.dumps(log)[:-1] + ', "runs": [' + json.dumps(run)[:-1] + ', "results": [\n', "]}]}\n"),
    }
    for f in formats:
        head, tail = ends[f]
        # The comma before the first finding is left out.
        join_files(spark, f"{parts}/format={f}", f"{out_dir}/report.{f}", head.encode(), tail.encode(),
                   skipped=0 if f == "csv" else 1)
    return summary


def _known(formats: Iterable[str]) -> list[str]:
    formats = list(formats)
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown report formats: {sorted(unknown)}")
    return formats


def write_reports(
    findings: DataFrame,
    out_dir: str,
    options: ScanOptions | None = None,
    formats: Iterable[str] = FORMATS,
    timestamp: str | None = None,
    described: Mapping[str, str] | None = None,
) -> dict:
    """Write the wanted formats below ``out_dir`` and return the summary.

    The layout is the same for every size: folders of parts.  The findings are stored once; the
    scan is not repeated per format.  ``described`` has the descriptions of user patterns.
    """
    options = options or ScanOptions()
    formats = _known(formats)
    stored = materialize(findings, "findings")
    summary = report_summary(stored)
    if "json" in formats:
        write_json_report(stored, f"{out_dir}/report.json", f"{out_dir}/report_summary.json",
                          options, summary, timestamp)
    if "csv" in formats:
        write_csv_report(stored, f"{out_dir}/report.csv")
    if "sarif" in formats:
        write_sarif_report(stored, f"{out_dir}/report.sarif", options, described)
    return summary
