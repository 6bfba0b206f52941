"""From files to findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from keysift.catalog import Pattern
from keysift.operators.blame import with_blame
from keysift.operators.dedup import deduplicate
from keysift.operators.findings import assess
from keysift.operators.incremental import new_findings
from keysift.operators.match import find_matches
from keysift.options import ScanOptions


def detect(
    files: DataFrame,
    options: ScanOptions | None = None,
    custom: Iterable[Pattern] = (),
    known_fakes: DataFrame | None = None,
) -> DataFrame:
    """Every finding in ``files(repo, path, content)``.  Rows stay where they are read."""
    return assess(find_matches(files, custom), options or ScanOptions(), known_fakes)


def scan(
    files: DataFrame,
    options: ScanOptions | None = None,
    custom: Iterable[Pattern] = (),
    baseline: DataFrame | None = None,
    blame: DataFrame | None = None,
    known_fakes: DataFrame | None = None,
    more: DataFrame | None = None,
) -> DataFrame:
    """A whole scan: detect, deduplicate, drop what the baseline has, attach authors.

    ``more`` holds findings made otherwise, such as those of files in pieces.
    """
    options = options or ScanOptions()
    findings = detect(files, options, custom, known_fakes)
    if more is not None:
        findings = findings.unionByName(more)
    if options.deduplicate:
        findings = deduplicate(findings)
    if options.incremental and baseline is not None:
        findings = new_findings(findings, baseline, options.deduplicate)
    if options.attach_blame and blame is not None:
        findings = with_blame(findings, blame)
    return findings
